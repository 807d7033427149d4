import re
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from tieweave.llm import urls


def plain_parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def plain_rule(host, path):
    fits = [
        (len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits, default=(0, None, None))[1:]


URLS = [
    "http://Example.ORG/es/1", "https://www.example.org/en/17?x=/es/", "http://a.b.org", "http://a.b.org/", "http://badexample.org/es/2",
    "http://x.com/fr/", "http://x.com/fr", "http://x.com/DE/", "http://x.com/de/9#a", "http://com/de/", None, "", "no url", "x://", "://org/",
    "http://u@h.org:80/a://b", "ftp://org?/fr/", "http://org#://com/de/", "HTTP://ÄB.org/ü/", "http://x.net/a\nb/", "http://org/" + "z" * 5000,
]


def test_parts_and_listed_rules(spark):
    pages = spark.createDataFrame([(n, u) for n, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, block boolean")
    found = urls.judge(pages.select("*", F.lit(1).alias("tokens"), F.lit(2).alias("pattern")), labels).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        url = URLS[r.page_id or 0]
        assert (r.host, r.path) == plain_parts(url), url
        rule, verdict = plain_rule(r.host, r.path)
        assert (r.rule, r.verdict) == (rule, verdict or "allow"), url


def plain_mined(baskets, min_support, min_confidence):
    """Every rule, by counting every combination of tokens."""
    counts, blocked = {}, {}
    for items, block in baskets:
        for n in range(1, len(items) + 1):
            for part in combinations(sorted(items), n):
                counts[part] = counts.get(part, 0) + 1
                blocked[part] = blocked.get(part, 0) + block
    out = set()
    least = min_support * len(baskets)
    for part, n in counts.items():
        for verdict, hits in (("block", blocked[part]), ("allow", n - blocked[part])):
            if hits >= least and hits and hits / n >= min_confidence:
                out.add((part, verdict, round(hits / n, 9)))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for n in range(400):
        host = f"h{n % 7}.x.net"
        block = n % 7 == 3 and n % 2 == 0 or n % 50 == 1
        rows.append((n, f"https://{host}/{'ab'[n % 2]}/{n}" + ("?q=1" if n % 3 else ""), block))
    return spark.createDataFrame(rows, "page_id long, url string, block boolean")


def test_mined_rules_and_matches_against_brute_force(spark, labelled):
    host, path = urls.host(F.col("url")), urls.path(F.col("url"))
    frame = labelled.select("page_id", "block", urls.tokens(F.col("url"), host, path).alias("tokens"))
    baskets = [(r.tokens, r.block) for r in frame.collect()]
    wanted = plain_mined(baskets, 0.05, 0.7)
    rules = urls.mine(frame.select("tokens", "block"), 0.05, 0.7)
    assert {(tuple(r["items"]), r.verdict, round(r.confidence, 9)) for r in rules.collect()} == wanted
    support = {}
    for items, block in baskets:
        for part, verdict, _ in wanted:
            if set(part) <= set(items) and (verdict == "block") == bool(block):
                support[part, verdict] = support.get((part, verdict), 0) + 1
    patterns = frame.select(F.array_join("tokens", " ").alias("pattern"), "tokens").distinct()
    found = {r.pattern: r.mined for r in urls.matched(patterns, rules).collect()}
    for items in {tuple(i) for i, _ in baskets}:
        fits = [(c, support[p, v], len(p), " ".join(p), v) for p, v, c in wanted if set(p) <= set(items)]
        assert found.get(" ".join(items)) == max(fits, default=(None,))[-1]


def test_mined_verdicts_take_effect(spark, labelled):
    found = {r.page_id: r for r in urls.judge(labelled.select("page_id", "url"), labelled.select("page_id", "block")).collect()}
    assert all(r.rule is None for r in found.values())
    assert all((found[n].verdict == "block") for n in range(400) if n % 7 == 3 and n % 2 == 0)
    assert sum(r.verdict == "block" for r in found.values()) < 80


def test_nothing(spark, labelled):
    none = labelled.limit(0)
    assert urls.judge(none, labelled).collect() == []
    assert {r.verdict for r in urls.judge(labelled, none).collect()} == {"allow"}
    nulls = labelled.withColumn("block", F.lit(None).cast("boolean"))
    assert {r.verdict for r in urls.judge(labelled, nulls).collect()} == {"allow"}
    assert {r.verdict for r in urls.judge(labelled, labelled.withColumn("block", F.lit(True))).collect()} == {"block"}
