"""URL filters: fixed rules first, then a path-template tree for each host, judged by smoothed labelled purity.

A path segment stays literal if enough of its host's different urls have it at that place; else it becomes a wildcard, with what surrounds its digits (``*.html``) if
enough urls share that. The wildcards after the last literal are one. Templates and their prefixes are the tree. Branches of one parent whose labelled purity does not differ by
more than chance (a z-test) merge, in order of their purity; merged branches that do not differ from their parent are judged by the parent's counts. A template
is rejected if its smoothed purity falls below a threshold. All of it is DataFrame operations on counts, in as many passes for deep paths as for flat ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kinetrail.llm.store import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


class TemplateFilter:
    """judge(pages, labels): page_id, host, path, rule, verdict, template, purity.

    labels: (page_id, good) with good 0 or 1 for some pages; an id with several labels counts each of them. A segment or shape is literal from support different
    urls on if they are at least share of its host's at that place, so a parent has at most 2 / share + 1 branches. z: how many standard errors apart branches must be.
    prior: weight of the overall purity in the smoothing; urls of an unlabelled host have that purity. Null urls have empty host and path and
    are judged as a host of their own; repeated rows each get their row and count once for support; extra columns are ignored; an empty table gives an empty result.
    """

    #: Hosts and templates up to this number are broadcast; beyond it they are joined by a shuffle.
    BROADCAST_ROWS = 100_000

    def __init__(self, rules: list[Rule], support: int = 20, share: float = 0.02, z: float = 2.6, prior: float = 8.0, threshold: float = 0.5):
        self.rules, self.support, self.share, self.z, self.prior, self.threshold = rules, support, share, z, prior, threshold

    def _small(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= self.BROADCAST_ROWS else table

    @staticmethod
    def _segments() -> Column:
        return F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("path", "^/", ""), "/", -1))

    def _literals(self, pages: DataFrame) -> DataFrame:
        """host, marks: ``place:segment`` of literal segments, ``place*shape`` of literal shapes."""
        urls = pages.select("host", "path").distinct().select("host", F.posexplode(self._segments()).alias("at", "seg"))
        shape = F.regexp_replace("seg", "[0-9]+", "*")
        shaped = F.when((shape != F.col("seg")) & (shape != "*"), F.concat("at", F.lit("*"), shape))
        marks = F.array(F.concat("at", F.lit(":"), "seg"), shaped, F.concat("at", F.lit("=")))
        counts = urls.select("host", "at", F.explode(marks).alias("mark")).where("mark is not null").groupBy("host", "at", "mark").agg(F.count("*").alias("k"))
        counts = written(counts.where(F.col("k") >= self.support), "marks")
        total = counts.where(F.col("mark") == F.concat("at", F.lit("="))).select("host", "at", F.col("k").alias("all"))
        literal = counts.join(total, ["host", "at"]).where((F.col("k") >= self.share * F.col("all")) & (F.col("mark") != F.concat("at", F.lit("="))))
        return written(literal.groupBy("host").agg(F.sort_array(F.collect_list("mark")).alias("marks")), "literals")

    def _templates(self, pages: DataFrame) -> DataFrame:
        """pages with their template as an array of segments."""
        some = pages.join(self._small(self._literals(pages)), "host", "left")
        marks = F.coalesce("marks", F.array().cast("array<string>"))

        def kept(seg, at):
            shape = F.regexp_replace(seg, "[0-9]+", "*")
            return F.when(F.array_contains(marks, F.concat(at, F.lit(":"), seg)), seg).when(F.array_contains(marks, F.concat(at, F.lit("*"), shape)), shape).otherwise("*")

        some = some.withColumn("segs", F.transform(self._segments(), kept))
        last = F.coalesce(F.array_max(F.transform("segs", lambda x, i: F.when(x != "*", i + 1).otherwise(0))), F.lit(0))
        end = F.when(F.size("segs") > last, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
        return some.withColumn("template", F.concat(F.slice("segs", F.lit(1), last), end)).drop("segs", "marks")

    def _apart(self, a: Column, b: Column) -> Column:
        """Whether two counts (n, g) differ by more than chance."""
        p = (a["g"] + b["g"] + 1) / (a["n"] + b["n"] + 2)
        return F.abs(a["g"] / a["n"] - b["g"] / b["n"]) > self.z * F.sqrt(p * (1 - p) * (1 / a["n"] + 1 / b["n"]))

    def _tree(self, leaves: DataFrame) -> DataFrame:
        """host, template, n, g: the counts that judge each template. leaves: host, template, n, g."""
        prefix = lambda i: F.array_join(F.transform(F.slice("template", F.lit(1), i), lambda x: F.concat(F.lit("/"), x)), "")
        steps = F.transform(F.sequence(F.lit(0), F.size("template")), lambda i: F.struct(i.alias("level"), prefix(i).alias("node"), F.when(i > 0, prefix(i - 1)).alias("parent")))
        places = leaves.select("host", "template", "n", "g", F.explode(steps).alias("s")).select("host", "template", "n", "g", "s.level", "s.node", "s.parent")
        nodes = written(places.groupBy("host", "level", "node", "parent").agg(F.sum("n").alias("n"), F.sum("g").alias("g")), "nodes")
        kid = F.struct(((F.col("g") + 1) / (F.col("n") + 2)).alias("rate"), "node", "n", "g")
        kids = nodes.where("parent is not null and n > 0").groupBy("host", "level", "parent").agg(F.sort_array(F.collect_list(kid)).alias("kids"))

        def merged(done, x):
            last = F.element_at(done, -1)
            one = F.struct(x["n"].alias("n"), x["g"].alias("g"), F.array(x["node"]).alias("nodes"))
            more = F.struct((last["n"] + x["n"]).alias("n"), (last["g"] + x["g"]).alias("g"), F.concat(last["nodes"], F.array(x["node"])).alias("nodes"))
            return F.when(F.size(done) == 0, F.array(one)).when(self._apart(last, x), F.concat(done, F.array(one))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more)))

        zero = F.array().cast("array<struct<n:bigint,g:bigint,nodes:array<string>>>")
        groups = kids.select("host", "level", "parent", F.explode(F.aggregate("kids", zero, merged)).alias("c")).select("host", "level", "parent", F.col("c.n").alias("cn"), F.col("c.g").alias("cg"), F.explode("c.nodes").alias("node"))
        above = nodes.select("host", (F.col("level") + 1).alias("level"), F.col("node").alias("parent"), F.col("n").alias("pn"), F.col("g").alias("pg"))
        rate = (F.col("pg") + 1) / (F.col("pn") + 2)
        own = groups.join(above, ["host", "level", "parent"]).where(F.abs(F.col("cg") - rate * F.col("cn")) > self.z * F.sqrt(rate * (1 - rate) * F.col("cn"))).select("host", "level", "node", "cn", "cg")
        own = own.unionByName(nodes.where("level = 0").select("host", "level", "node", F.col("n").alias("cn"), F.col("g").alias("cg")))
        judged = places.select("host", "template", "level", "node").join(own, ["host", "level", "node"])
        return judged.groupBy("host", "template").agg(F.max_by(F.struct("cn", "cg"), "level").alias("c")).select("host", "template", F.col("c.cn").alias("n"), F.col("c.cg").alias("g"))

    def judge(self, pages: DataFrame, labels: DataFrame) -> DataFrame:
        host, path = parsed(F.col("url"))
        pages = self._templates(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")))
        good = F.col("good").cast("int")
        counts = labels.where(good.isin(0, 1)).groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.count("*").alias("n"), F.sum(good).alias("g"))
        leaves = pages.join(counts, "page_id", "left").groupBy("host", "template").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("g", F.lit(0))).alias("g"))
        leaves = written(leaves, "leaves")
        overall = leaves.agg(F.coalesce(F.sum("g") / F.nullif(F.sum("n"), F.lit(0)), F.lit(1.0)).alias("p")).first()["p"]
        purity = (F.col("g") + self.prior * overall) / (F.col("n") + self.prior)
        tree = written(self._tree(leaves).select("host", "template", purity.alias("purity")), "templates")
        rule, verdict = matched(F.col("host"), F.col("path"), self.rules)
        own = F.when(F.col("purity") < self.threshold, "block").otherwise("allow")
        name = F.array_join(F.transform("template", lambda x: F.concat(F.lit("/"), x)), "")
        return pages.join(self._small(tree), ["host", "template"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), name.alias("template"), F.round("purity", 9).alias("purity"))
