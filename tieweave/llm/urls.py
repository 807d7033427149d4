"""URL filters: a list of rules, and association rules mined from labelled URLs for the rest."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieweave.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The listed rules, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A mined rule covers at least this share of the labelled pages, and is right for this share of
#: those it covers.
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
_BLOCK, _ALLOW = "verdict=block", "verdict=allow"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits, or null."""
    found = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_ == rule_host) | host_.endswith("." + rule_host)) & path_.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """The distinct tokens of a URL, sorted: scheme, labels of the host, words of the path, names in the
    query.  Runs of digits are one token, so numbers do not make every URL its own."""
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)))
    word = F.lit(r"[^\W\d_]+|\d+")
    plain = lambda w: F.when(w.rlike(r"^\d+$"), F.lit("#")).otherwise(F.lower(w))
    labels = F.transform(F.filter(F.split(host_, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.regexp_extract_all(path_, word, F.lit(0)), lambda x: F.concat(F.lit("p:"), plain(x)))
    names = F.transform(
        F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x)
    )
    return F.array_sort(F.array_distinct(F.concat(scheme, labels, words, names)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (key, items, verdict, confidence, support) from ``labelled`` (tokens, block: boolean).

    FP-growth finds the frequent combinations of tokens and verdict; a rule is a combination of
    tokens that has a verdict often enough.  ``key`` is its token in the fewest pages, under which
    the inverted index holds it.
    """
    verdict = F.when(F.col("block"), F.lit(_BLOCK)).otherwise(F.lit(_ALLOW))
    baskets = labelled.where(F.col("block").isNotNull()).select(F.array_append("tokens", verdict).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    frequent = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("key"), F.col("freq"))
    found = model.associationRules.where(
        F.col("consequent")[0].isin(_BLOCK, _ALLOW)
        & ~F.arrays_overlap("antecedent", F.array(F.lit(_BLOCK), F.lit(_ALLOW)))
    ).select(
        F.array_sort("antecedent").alias("items"),
        F.when(F.col("consequent")[0] == _BLOCK, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        "confidence", "support",
    )
    each = found.select("*", F.explode("items").alias("key")).join(frequent, "key")
    rarest = Window.partitionBy("items", "verdict").orderBy("freq", "key")
    picked = each.withColumn("nth", F.row_number().over(rarest)).where("nth = 1")
    return materialize(picked.select("key", "items", "verdict", "confidence", "support"), "rules")


def matched(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """The verdict of the best mined rule of each of ``patterns`` (pattern, tokens), where one matches.

    A pattern meets the rules whose key is among its tokens, and a rule matches if all its tokens
    are.  Best: higher confidence, then support, then more tokens, then by the tokens.
    """
    met = patterns.select("pattern", "tokens", F.explode("tokens").alias("key")).join(rules, "key")
    fits = met.where(F.size(F.array_except("items", "tokens")) == 0)
    better = F.struct(F.col("confidence"), F.col("support"), F.size("items"), F.array_join("items", " "), F.col("verdict"))
    return fits.groupBy("pattern").agg(F.max_by("verdict", better).alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judges each of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    The longest listed rule that fits decides.  Elsewhere the rules mined from ``labels`` (page_id,
    block) do, and where none matches, the verdict that most labelled pages have (``allow`` in a
    tie or without labels).  Pages with equal tokens are matched once, so a frequent host is not
    matched for each of its pages.

    A null URL or one without ``://`` has an empty host and path and only the token of an empty
    scheme.  Repeated rows are judged alike; labels that repeat a page count once, as block if
    any says so.  Empty tables give no rows, and without labels no rules.  Other columns are not
    read.
    """
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select(
        "page_id", host(url).alias("host"), path(url).alias("path"), tokens(url, host(url), path(url)).alias("tokens")
    )
    rows = materialize(
        rows.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules)).withColumn(
            "pattern", F.sha2(F.array_join("tokens", "\n"), 256)
        ),
        "pages",
    )
    known = labels.select(F.col("page_id").cast("long").alias("page_id"), "block").where(
        F.col("page_id").isNotNull() & F.col("block").isNotNull()
    ).groupBy("page_id").agg(F.max("block").alias("block"))
    labelled = rows.select("page_id", "tokens").join(known, "page_id")
    counts = known.join(rows.select("page_id"), "page_id").agg(F.count_if("block"), F.count("*")).first()
    patterns = rows.groupBy("pattern").agg(F.min("tokens").alias("tokens"))
    default = "block" if 2 * counts[0] > counts[1] else "allow"
    if counts[1]:
        # Written, so that the join is not tied to the aggregation and a frequent pattern can be split.
        mined = materialize(matched(patterns, mine(labelled.select("tokens", "block"))), "mined")
        rows = rows.join(mined, "pattern", "left")
    else:
        rows = rows.withColumn("mined", F.lit(None).cast("string"))
    return rows.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "mined", F.lit(default)).alias("verdict"),
    )
