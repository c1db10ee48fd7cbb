"""The queries opN_<name> of this subpackage and their SQL, where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetrail.llm import secrets, sharding
from kinetrail.llm.decontaminate import Decontaminate
from kinetrail.llm.html_text import HtmlText
from kinetrail.llm.jaccard_join import JaccardJoin
from kinetrail.llm.labelled import fold
from kinetrail.llm.mixing import Mixer
from kinetrail.llm.quality_classifier import QualityClassifier
from kinetrail.llm.quality_rules import COUNTS, QualityRules
from kinetrail.llm.secrets import SecretScan
from kinetrail.llm.sharding import Sharding
from kinetrail.llm.store import ship
from kinetrail.llm.toxicity import Toxicity
from kinetrail.llm.url_filter import Rule, TemplateFilter, parsed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed by the contract of op2.
RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]
#: Token shares that the mixing queries aim at.
TARGETS = {"en": 0.55, "fr": 0.18, "de": 0.18, "es": 0.09}


def domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing queries: labelled documents with their language as domain."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Decontaminate().hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labels are those of the document that its url numbers: the first numeric segment of the path."""
    pages = table(spark, sf_dir, "pages")
    doc = F.regexp_extract(parsed(F.col("url"))[1], r"/([0-9]{1,18})(?:[/.]|$)", 1)
    numbered = pages.select("page_id", F.when(doc != "", doc.cast("long")).alias("doc_id")).where("doc_id is not null")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return TemplateFilter(RULES).judge(pages, numbered.join(labels, "doc_id").select("page_id", "good"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = HtmlText().extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = QualityClassifier().fit(docs, labels).score(docs)
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op5_target_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Mixer(TARGETS).fit(docs, domains(docs, table(spark, sf_dir, "labels"))).rates(docs)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return QualityRules().fit(docs, labels).judge(docs).select("doc_id", *COUNTS, "base_failed", "kept", "probability")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_links: how many other sets a document's set links with, equal sets being one."""
    found = JaccardJoin().similar(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(SecretScan().scan(table(spark, sf_dir, "documents")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(Sharding(shards=24).shuffled(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = Toxicity().fit(docs, labels).score(docs)
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w
), s AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM g), k AS (SELECT doc_id, md5(array_to_string(list_sort(g), chr(31))) AS k FROM g),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
degree AS (SELECT x AS id, count(DISTINCT b.k) AS d FROM sym JOIN k a ON a.doc_id = x JOIN k b ON b.doc_id = y WHERE a.k <> b.k GROUP BY x),
reach(id, r) AS (SELECT DISTINCT x, x FROM sym UNION SELECT reach.id, sym.y FROM reach JOIN sym ON reach.r = sym.x),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, coalesce(c, g.doc_id) AS component_id, coalesce(d, 0) AS n_links
FROM g LEFT JOIN comp ON comp.id = g.doc_id LEFT JOIN degree ON degree.id = g.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_jaccard_join": OP7_SQL}
