"""Secret scanning with a random forest that takes out false positives; Spark columns throughout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieweave.session import materialize

_NAME = r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key|auth|bearer|credential)s?"
#: A candidate: a quoted value that something is set to, a value after a credential's name, or a long run of
#: key characters that is neither the name before a ``=`` nor a credential's name that something is set to.
#: Short looks at the sign before come first, so that the long ones are taken at few places.
CANDIDATE = (
    r"""(?<=["'])(?<=[:=]\s{0,2}["'])[^\s"']{8,}(?=["'])"""
    rf"""|(?<=[:=\s"'])(?<=[:=]\s{{0,2}}["']?)(?i:(?<=(?<![a-z0-9]){_NAME}["']?\s{{0,2}}[:=]\s{{0,2}}["']?))[^\s"'`&,;<>(){{}}\[\]=:][^\s"'`&,;<>(){{}}\[\]]{{4,}}[^\s"'`&,;<>(){{}}\[\].:!?]"""
    r"""|(?=[A-Za-z0-9+/=_\-]{16})(?![A-Za-z0-9_\-]{0,80}+=[A-Za-z0-9+/_\-])"""
    rf"""(?!(?i:[a-z0-9_\-]{{0,80}}(?<![a-z0-9]){_NAME}["']?\s{{0,2}}[:=]))(?!=\w)[A-Za-z0-9+/=_\-]{{16,}}"""
)
#: ``_`` and ``-`` join names as blanks part them.
CREDENTIAL = rf"(?i)(?<![a-z0-9]){_NAME}(?![a-z0-9])"
#: Shapes of keys that their makers give them.
KNOWN = (
    r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|sk_(live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]{10,}.*)$"
)
REFERENCE = r"(?i)\b(sha\d*|md5|commit|hash|checksum|digest|uuid|guid|isbn|order|invoice|phone|id|ref)\b"
FEATURES = (
    "length", "transitions", "digits", "upper", "symbols", "distinct", "hexadecimal", "coverage", "in_path",
    "assigned", "quoted", "credential_near", "reference_near", "words_before",
)
#: Labelled findings that the forest is fitted on, about, chosen by a hash of value and place.
TRAINING_FINDINGS = 20_000
MASK = "[SECRET]"


def row_key() -> Column:
    """md5 of id and text: what holds a finding to its row."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]))


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate in ``docs`` (doc_id, text): doc_id, row_key, start, value, before, after.

    ``start`` counts code points.  ``before`` and ``after`` are up to 80 and 40 characters around it.
    """
    text = F.coalesce("text", F.lit(""))
    pattern = F.lit(CANDIDATE)
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, CANDIDATE, -1).alias("rests"),
    ).where(F.size("hits") > 0)
    # The text is rest, hit, rest, hit, ..., rest: lengths give the places.
    step = lambda ends, n: F.concat(
        ends, F.array(F.element_at(ends, -1) + F.length(F.get("rests", n)) + F.length(F.get("hits", n)))
    )
    ends = F.aggregate(F.sequence(F.lit(0), F.size("hits") - 1), F.array(F.lit(0)), step)
    placed = cut.withColumn("ends", ends)
    found = F.transform(
        "hits",
        lambda hit, n: F.struct(
            (F.get("ends", n) + F.length(F.get("rests", n))).cast("long").alias("start"), hit.alias("value"),
            F.right(F.get("rests", n), F.lit(80)).alias("before"), F.left(F.get("rests", n + 1), F.lit(40)).alias("after"),
        ),
    )
    return placed.select("doc_id", "row_key", F.inline(found))


def dictionary(docs: DataFrame) -> DataFrame:
    """Letter trigrams (gram) of the words of all ``docs`` (text) that are more frequent than chance.

    Words of a-z are counted first, so each different word is cut once.  There are 26^3 trigrams at
    most.
    """
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+")).alias("word"))
    counted = words.where(F.length("word").between(3, 30)).groupBy("word").agg(F.count("*").alias("n"))
    grams = counted.select(F.explode(_trigrams(F.col("word"))).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "trigrams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    return grams.where(F.col("n") > total / 26**3).select("gram")


def _trigrams(value: Column) -> Column:
    last = F.length(value) - 2
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda n: F.substring(value, n, F.lit(3)))).otherwise(
        F.array().cast("array<string>")
    )


def with_features(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the features of the forest to candidates; ``known`` is the dictionary's trigrams.

    Coverage is the share of the letters' trigrams that the dictionary holds; it is computed once
    for each different value, and the dictionary (26^3 short rows at most) is sent to all tasks.
    """
    values = found.select("value").distinct()
    grams = values.select("value", F.explode(_trigrams(F.lower("value"))).alias("gram"))
    covered = grams.join(F.broadcast(known.withColumn("known", F.lit(1))), "gram", "left").groupBy("value").agg(
        (F.count("known") / F.count("*")).alias("coverage")
    )
    value, size = F.col("value"), F.length("value").cast("double")
    share = lambda chars: F.length(F.regexp_replace(value, f"[^{chars}]", "")) / size
    classes = value
    for chars, letter in (("a-z", "a"), ("A-Z", "A"), ("0-9", "0"), ("^aA0", "-")):
        classes = F.regexp_replace(classes, f"[{chars}]", letter)
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    # Written, so that the join below is not tied to the aggregation and a frequent value can be split.
    covered = materialize(covered, "coverage")
    number = lambda condition: condition.cast("double")
    wide = found.join(covered.withColumnRenamed("value", "of_value"), value == F.col("of_value"), "left").drop("of_value")
    return wide.select(
        *found.columns, F.coalesce("coverage", F.lit(0.0)).alias("coverage"), size.alias("length"),
        ((runs - 1) / size).alias("transitions"), share("0-9").alias("digits"), share("A-Z").alias("upper"),
        (1 - share("A-Za-z0-9")).alias("symbols"),
        (F.size(F.array_distinct(F.split(value, ""))) / size).alias("distinct"),
        number(value.rlike("^[0-9a-fA-F]+$")).alias("hexadecimal"),
        number(value.contains("/") | F.col("before").rlike(r"[/\\.@]$") | F.col("after").rlike(r"^[/\\.@]")).alias("in_path"),
        number(F.col("before").rlike(r"""[:=]\s*["']?$""")).alias("assigned"),
        number(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).alias("quoted"),
        number(F.regexp_extract("before", r"(?:\S+\s+){0,2}\S*\s*$", 0).rlike(CREDENTIAL)).alias("credential_near"),
        number(F.regexp_extract("before", r"(?:\S+\s+){0,2}\S*\s*$", 0).rlike(REFERENCE)).alias("reference_near"),
        F.regexp_count("before", F.lit(r"\S+")).cast("double").alias("words_before"),
    )


def labels_by_rule(featured: DataFrame) -> DataFrame:
    """Adds ``label``: findings that their neighbours and characters settle; null for the others.

    1: set to or quoted after a credential's name, with letters and digits mixed, or of a known key's
    shape.  0: no credential's name near, or made of dictionary words or of digits alone.  This stands
    in where no person has labelled findings.
    """
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1) & (F.col("coverage") < 0.5)
    settled = (F.col("credential_near") == 1) & (F.col("assigned") == 1) & mixed
    never = ((F.col("credential_near") == 0) & (F.col("assigned") == 0)) | (F.col("digits") == 1) | (F.col("coverage") > 0.8)
    return featured.withColumn("label", F.when(settled | F.col("value").rlike(KNOWN), 1.0).when(never, 0.0))


@dataclass
class Forest:
    """A fitted forest; without one (labels of one kind or none) ``labels_by_rule`` judges each candidate."""

    model: RandomForestClassificationModel | None

    def judged(self, featured: DataFrame) -> DataFrame:
        """Adds ``probability`` and ``secret`` (0.5 or more)."""
        if self.model is None:
            ruled = labels_by_rule(featured).withColumn("probability", F.coalesce("label", F.lit(0.0)))
            return ruled.select(*featured.columns, "probability", (F.col("probability") == 1).alias("secret"))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector").transform(featured)
        scored = self.model.transform(vectors)
        chance = vector_to_array("_chance")[1]
        return scored.select(*featured.columns, chance.alias("probability"), (chance >= 0.5).alias("secret"))


def fit(labelled: DataFrame, most: int = TRAINING_FINDINGS) -> Forest:
    """Fits the forest on about ``most`` of the labelled findings (features, value, label: 1, 0 or null)."""
    kinds = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = kinds.get(0.0, 0) + kinds.get(1.0, 0)
    if not kinds.get(0.0) or not kinds.get(1.0):
        return Forest(None)
    kept = F.lit(False)
    for label in (0.0, 1.0):  # half of the room for each kind
        share = min(1.0, most / 2 / kinds[label])
        chosen = F.pmod(F.xxhash64("value", "row_key", "start"), F.lit(1 << 20)) < share * (1 << 20)
        kept = kept | ((F.col("label") == label) & chosen)
    weight = F.when(F.col("label") == 1, total / kinds[1.0]).otherwise(total / kinds[0.0])
    rows = labelled.where(kept).withColumn("_weight", F.least(weight, F.lit(20.0)))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="_vector", labelCol="label", weightCol="_weight", probabilityCol="_chance", rawPredictionCol="_raw",
        predictionCol="_kind", numTrees=20, maxDepth=5, seed=11,
    )
    return Forest(forest.fit(vectors.select("_vector", "label", "_weight")))


def scan(docs: DataFrame) -> DataFrame:
    """Every candidate in ``docs`` (doc_id, text), judged: doc_id, row_key, start, value, the features,
    probability, secret.

    The dictionary counts all documents.  Null texts count as empty and have no candidates; rows
    that repeat give their findings each.  An empty table gives no rows.  Other columns are not
    read.
    """
    docs = docs.select("doc_id", "text")
    found = materialize(candidates(docs), "candidates")
    featured = materialize(labels_by_rule(with_features(found, dictionary(docs))), "findings")
    return fit(featured).judged(featured)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) with each secret replaced by ``[SECRET]``; ``n_chars``, if
    there, is that of the new text.  Every row stays.

    A secret is masked where it was found, and elsewhere in its document only as a whole word; all other
    text stays as it is.  Rows of null ids and texts are kept; long texts are passed over once for each of
    their secrets.
    """
    columns = [c for c in docs.columns if not c.startswith("_secret")]
    secrets = scan(docs).where("secret").groupBy(F.col("row_key").alias("_secret_key")).agg(
        F.sort_array(F.collect_set(F.struct("start", F.length("value").alias("size"), "value"))).alias("_secrets")
    )
    # One document's own values, so a list is never longer than a text.
    rows = docs.select(*columns, row_key().alias("_secret_key")).join(secrets, "_secret_key", "left")
    begun = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate(
        "_secrets", begun,
        lambda done, one: F.struct(
            F.concat(done["out"], F.substring("text", done["at"] + 1, one["start"].cast("int") - done["at"]), F.lit(MASK)).alias("out"),
            (one["start"].cast("int") + one["size"]).alias("at"),
        ),
        lambda done: F.concat(done["out"], F.substring("text", done["at"] + 1, F.length("text"))),
    )
    word = lambda value: F.concat(
        F.lit(r"(?<![A-Za-z0-9_])"), F.regexp_replace(value, r"([^A-Za-z0-9])", r"\\$1"), F.lit(r"(?![A-Za-z0-9_])")
    )
    values = F.array_distinct(F.transform("_secrets", lambda one: one["value"]))
    masked = F.aggregate(values, cut, lambda text, value: F.regexp_replace(text, word(value), F.lit(MASK)))
    out = rows.withColumn("text", F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars", F.when(F.col("_secrets").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
        )
    return out.select(*columns)
