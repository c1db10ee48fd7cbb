import math
import random
import re
from collections import defaultdict

from brute import url_rule
from pyspark.sql import functions as F

from kinetrail.llm import queries as Q
from kinetrail.llm.url_filter import TemplateFilter


def test_hosts_paths_and_rules(spark):
    d = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in Q.op2_url_filter(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        host, path, rule, verdict = url_rule(p.url)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_odd_urls(spark):
    urls = [None, "", "no scheme/x", "http://A.Example.ORG?x=/es/", "HTTP://EXAMPLE.org/es/1#f", "x://org", "x://org/", "a://b.com/fr/://c.org/", "http://sub.example.org/en/12", "http://exampleXorg/es/", "ftp://com/de/é?q"]
    pages = spark.createDataFrame([(i, u, u) for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in TemplateFilter(Q.RULES).judge(pages, labels).collect()}
    assert got == {i: url_rule(u)[:3] for i, u in enumerate(urls)}
    assert TemplateFilter(Q.RULES).judge(pages.limit(0), labels).count() == 0
    assert TemplateFilter(Q.RULES).judge(pages.union(pages), labels).count() == 2 * len(urls)


def test_templates_by_purity(spark):
    """One host, two literal branches and numbers below them: the bad branch goes, the good one and the unlabelled host stay."""
    rows = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i * 7919}") for i in range(400)] + [(1000 + i, f"http://other.net/{i}") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "page_id long, good int")
    got = TemplateFilter([]).judge(pages, labels)
    assert {(r.template, r.verdict) for r in got.where("host = 'h.net'").select("template", "verdict").distinct().collect()} == {("/spam/*", "block"), ("/news/*", "allow")}
    assert {r.verdict for r in got.where("host = 'other.net'").collect()} == {"allow"}
    # branches that do not differ share their parent's judgement
    mild = spark.createDataFrame([(i, int(i // 2 % 10 > 0)) for i in range(200)], "page_id long, good int")
    assert TemplateFilter([]).judge(pages, mild).where("host = 'h.net'").select(F.countDistinct("purity")).first()[0] == 1


def brute_verdicts(rows, labels, support=20, share=0.02, z=2.6, prior=8.0, threshold=0.5):
    """page -> (template, purity, verdict) without rules. rows: (page, url); labels: (page, good)."""
    where = {p: url_rule(u)[:2] for p, u in rows}
    cut = {hp: hp[1].removeprefix("/").split("/") if hp[1] else [] for hp in set(where.values())}
    seen, total = defaultdict(int), defaultdict(int)
    for (host, _), segs in cut.items():
        for i, s in enumerate(segs):
            shape = re.sub("[0-9]+", "*", s)
            seen[host, i, s, False] += 1
            seen[host, i, shape, True] += shape not in (s, "*")
            total[host, i] += 1

    def literal(host, i, s, shape):
        return seen[host, i, s, shape] >= max(support, share * total[host, i])

    def template(hp):
        host, out = hp[0], []
        for i, s in enumerate(cut[hp]):
            shape = re.sub("[0-9]+", "*", s)
            out.append(s if literal(host, i, s, False) else shape if literal(host, i, shape, True) else "*")
        n = max((i + 1 for i, s in enumerate(out) if s != "*"), default=0)
        return tuple(out[:n] + ["*"] * (len(out) > n))

    of = {p: (hp[0], template(hp)) for p, hp in where.items()}
    counts = defaultdict(lambda: [0, 0])
    for p, good in labels:
        if p in of:
            host, t = of[p]
            for i in range(len(t) + 1):
                counts[host, t[:i]][0] += 1
                counts[host, t[:i]][1] += good
    kids, judged = defaultdict(set), {}
    for host, t in set(of.values()):
        judged[host, ()] = counts[host, ()]
        for i in range(len(t)):
            kids[host, t[:i]].add(t[: i + 1])
    for (host, parent), names in kids.items():
        groups = []
        for t in sorted((t for t in names if counts[host, t][0]), key=lambda t: ((counts[host, t][1] + 1) / (counts[host, t][0] + 2), "".join("/" + x for x in t))):
            n, g = counts[host, t]
            if groups:
                m, h, members = groups[-1]
                p = (g + h + 1) / (n + m + 2)
                if not abs(h / m - g / n) > z * math.sqrt(p * (1 - p) * (1 / m + 1 / n)):
                    groups[-1] = (n + m, g + h, [*members, t])
                    continue
            groups.append((n, g, [t]))
        rate = (counts[host, parent][1] + 1) / (counts[host, parent][0] + 2)
        for n, g, members in groups:
            if abs(g - rate * n) > z * math.sqrt(rate * (1 - rate) * n):
                judged |= {(host, t): (n, g) for t in members}
    n, g = (sum(counts[h, ()][k] for h in {h for h, _ in of.values()}) for k in (0, 1))
    overall = g / n if n else 1.0
    out = {}
    for p, (host, t) in of.items():
        n, g = next(judged[host, t[:i]] for i in range(len(t), -1, -1) if (host, t[:i]) in judged)
        purity = (g + prior * overall) / (n + prior)
        out[p] = ("".join("/" + s for s in t), round(purity, 6), "block" if purity < threshold else "allow")
    return out


def made(seed=4):
    """Hosts whose branches differ in purity, two of them alike, one deep; labels of 0 and 1 by chance."""
    rng, rows, labels = random.Random(seed), [], []
    share = {"shop": 0.15, "promo": 0.2, "news": 0.9, "blog": 0.92}
    for i in range(6000):
        host = rng.choice(["a.net", "a.net", "b.net", "c.net", ""])
        branch = rng.choice(list(share))
        if host == "a.net":
            path, good = f"/{branch}/{rng.randrange(10**6)}{rng.choice(['', '.html', '/'])}", share[branch]
        elif host == "b.net":
            path, good = f"/x/y/z/{branch}/{rng.randrange(10**6)}/{rng.randrange(10**6)}", share[branch]
        elif host == "c.net":
            ending = rng.choice([".html", ".php"])
            path, good = f"/{rng.randrange(10**6)}{ending}", 0.1 if ending == ".php" else 0.95
        else:
            path, good = "", 0.8
        rows.append((i, f"http://{host}{path}" if host else rng.choice([None, "no scheme"])))
        if rng.random() < 0.5:
            labels.append((i, int(rng.random() < good)))
    return rows, labels


def test_against_a_brute_force_tree(spark):
    rows, labels = made()
    found = TemplateFilter([]).judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")).collect()
    assert {r.page_id: (r.template, round(r.purity, 6), r.verdict) for r in found} == brute_verdicts(rows, labels)
    named = {(r.host, r.template): (r.verdict, r.purity) for r in found}
    assert named["b.net", "/x/y/z/shop/*"] == named["b.net", "/x/y/z/promo/*"] and named["b.net", "/x/y/z/shop/*"][0] == "block" and named["b.net", "/x/y/z/news/*"][0] == "allow"
    assert named["c.net", "/*.php"][0] == "block" and named["c.net", "/*.html"][0] == "allow"
    d = "/root/testdata/sf0.1"
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()]
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    numbers = {p: re.search(r"/([0-9]{1,18})(?:[/.]|$)", url_rule(u)[1]) for p, u in pages}
    labels = [(p, good[int(m[1])]) for p, m in numbers.items() if m and int(m[1]) in good]
    want, urls = brute_verdicts(pages, labels), dict(pages)
    for r in Q.op2_url_filter(spark, d).collect():
        assert (r.template, round(r.purity, 6)) == want[r.page_id][:2]
        assert r.verdict == (url_rule(urls[r.page_id])[3] or want[r.page_id][2])


def test_rejected_templates_are_worse_on_labels_not_seen(spark):
    rows, labels = made(9)
    seen, rest = labels[::2], dict(labels[1::2])
    found = TemplateFilter([]).judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(seen, "page_id long, good int")).collect()
    share = {v: [rest[r.page_id] for r in found if r.verdict == v and r.page_id in rest] for v in ("allow", "block")}
    good = {v: sum(x) / len(x) for v, x in share.items()}
    assert len(share["block"]) > 300 and good["block"] < 0.25 and good["allow"] > 0.8


def test_columns_and_long_paths(spark):
    pages = spark.createDataFrame([(i, f"http://h/{'a/' * 3000}{i}", "x") for i in range(30)], "page_id long, url string, verdict string")
    got = TemplateFilter(Q.RULES).judge(pages, spark.createDataFrame([(0, 0)], "page_id long, good int"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    assert got.select("template").distinct().count() == 1
