import random
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.config import Config
from tieweave.operators import values as values_module
from tieweave.operators.profiles import column_profiles, profiling_modes, sampled_scans, top_values
from tieweave.operators.strings import sample_values, string_profiles
from tieweave.operators.values import value_counts
from tieweave.sources.catalog import Catalog


def keys_of(spark, values, kind):
    c = Catalog(spark, {"t.t": spark.createDataFrame([(v,) for v in values], f"v {kind}")})
    rows = value_counts(c).collect()
    return {(r.k_num, r.k_dbl, str(r.k_ts) if r.k_ts else None, r.k_txt): r.cnt for r in rows}


def test_numbers_meet_across_types(spark):
    assert set(keys_of(spark, [1], "int")) == {(1, None, None, None)}
    assert keys_of(spark, [1.0, -0.0, 0.0, 1.5], "double") == {
        (1, None, None, None): 1, (0, None, None, None): 2, (None, 1.5, None, None): 1
    }
    decimals = keys_of(spark, [Decimal("1.00"), Decimal("1.50"), None], "decimal(38,2)")
    assert decimals == {(1, None, None, None): 1, (None, 1.5, None, None): 1, (None, None, None, None): 1}
    wide = keys_of(spark, [Decimal("0.1234567890123456789000")], "decimal(38,22)")
    assert set(wide) == {(None, None, None, "0.1234567890123456789")}
    assert set(keys_of(spark, [True], "boolean")) == {(1, None, None, None)}


def test_large_integers_stay_exact(spark):
    big = 2**53
    found = keys_of(spark, [big, big + 1], "bigint")
    assert set(found) == {(big, None, None, None), (big + 1, None, None, None)}
    assert set(keys_of(spark, [float(big), 1e30], "double")) == {(big, None, None, None), (None, 1e30, None, None)}


def test_special_doubles_and_other_types(spark):
    found = keys_of(spark, [float("nan"), float("nan"), float("inf")], "double")
    assert sorted(found.values()) == [1, 2]
    assert len(keys_of(spark, [[1.0], [1.0], [2.0]], "array<float>")) == 2
    assert len(keys_of(spark, [b"a", b"a", b"b"], "binary")) == 2


def profiled(spark, frame):
    c = Catalog(spark, {"t.t": frame})
    return c, value_counts(c), c.columns_frame()


def test_nulls_empty_tables_and_range(spark):
    c = Catalog(
        spark,
        {
            "t.empty": spark.createDataFrame([], "a int, b string"),
            "t.full": spark.createDataFrame(
                [(1, None, "x", True), (None, None, "y", False), (3, None, None, True)],
                "n int, nothing double, s string, flag boolean",
            ),
        },
    )
    rows = {(r.table_name, r.column_name): r for r in column_profiles(value_counts(c), c.columns_frame()).collect()}
    empty = rows["empty", "a"]
    assert (empty.row_count, empty.distinct_count, empty.null_ratio, empty.min_num) == (0, 0, 0.0, None)
    n = rows["full", "n"]
    assert (n.row_count, n.non_null_count, n.null_count, n.distinct_count) == (3, 2, 1, 2)
    assert (n.null_ratio, n.distinct_ratio, n.uniqueness_ratio) == (0.333333, 1.0, 0.666667)
    assert (n.min_num, n.max_num, n.min_long) == (1.0, 3.0, 1)
    nothing = rows["full", "nothing"]
    assert (nothing.null_count, nothing.null_ratio, nothing.distinct_ratio) == (3, 1.0, 0.0)
    flag = rows["full", "flag"]
    assert (flag.distinct_count, flag.min_num, flag.max_num) == (2, None, None)


def test_top_values_with_long_texts(spark):
    long_a, long_b = "a" * 300 + "1", "a" * 300 + "2"
    c, values, columns = profiled(spark, spark.createDataFrame([(long_a,)] * 3 + [(long_b,)] * 2 + [("short",)], "v string"))
    rows = top_values(values, columns, c).orderBy("rank").collect()
    assert [(r.value_str, r.cnt) for r in rows] == [(long_a, 3), (long_b, 2), ("short", 1)]


def test_top_values_order_and_limit(spark):
    data = [(v,) for v in [5] * 3 + [7] * 3 + [1] + list(range(100, 120))]
    c, values, columns = profiled(spark, spark.createDataFrame(data, "v int"))
    rows = top_values(values, columns, c).orderBy("rank").collect()
    assert [int(r.value_num) for r in rows] == [5, 7, 1, 100, 101, 102, 103, 104, 105, 106]


def test_modes_and_sampling(spark):
    cases = [("t.a", 1000, 5), ("t.b", 100_000, 5), ("t.c", 200_000, 10), ("t.d", 200_000, 30), ("t.e", 600_000, 3)]
    columns = spark.createDataFrame(
        [(k, *k.split("."), "string") for k, _, n in cases for _ in range(n)],
        "table_key string, schema_name string, table_name string, family string",
    )
    counts = spark.createDataFrame([(k, r) for k, r, _ in cases], "table_key string, row_count long")
    rows = {r.table_key: (r.profiling_mode, r.sampled) for r in profiling_modes(columns, counts, Config()).collect()}
    assert rows == {"t.a": ("A", False), "t.b": ("A", False), "t.c": ("B", False), "t.d": ("C", False), "t.e": ("B", False)}
    c = Catalog(spark, {"t.big": spark.range(20_000).toDF("id")})
    config = Config(mode_a_max_rows=10, sample_fraction=0.1)
    scans = sampled_scans(c, profiling_modes(c.columns_frame(), c.row_counts(), config), config)
    taken = scans["t.big"].agg(F.count("id").alias("n"), F.max("id").alias("top")).first()
    assert 1500 < taken.n < 2500 and taken.top > 15_000
    moved = Catalog(spark, {"t.big": spark.range(20_000).toDF("id").repartition(7)})
    again = sampled_scans(moved, profiling_modes(c.columns_frame(), c.row_counts(), config), config)
    assert again["t.big"].exceptAll(scans["t.big"]).count() == 0 and again["t.big"].count() == taken.n
    off = Config(mode_a_max_rows=10)
    assert sampled_scans(c, profiling_modes(c.columns_frame(), c.row_counts(), off), off) == {}


def string_rows(spark, frame):
    c, values, columns = profiled(spark, frame)
    return {r.column_name: r for r in string_profiles(values, columns, column_profiles(values, columns), c).collect()}


def test_string_profile(spark):
    frame = spark.createDataFrame(
        [("A", "ABCD1234", "é ", None), ("a", "AB-123", "ab", None), (" a ", "12345678901", "ab", None), ("a  ", "TX12345", "cd", None)],
        "v string, ident string, plain string, status string",
    )
    rows = string_rows(spark, frame)
    v = rows["v"]
    assert (v.distinct_count, v.whitespace_normalized_distinct, v.lower_normalized_distinct) == (4, 2, 3)
    assert v.normalization_reduces and v.is_categorical and v.categorical_distinct_count == 4
    assert (v.avg_length, v.min_length, v.max_length) == (1.25, 1, 2)
    assert rows["ident"].is_identifier_like and rows["ident"].contains_numbers and rows["ident"].contains_special_chars
    assert not rows["plain"].is_identifier_like and not rows["plain"].contains_numbers
    status = rows["status"]
    assert (status.avg_length, status.sample_values, status.is_categorical) == (0.0, [], True)


def test_long_text_forms(spark):
    body = "Word " * 100
    texts = [body, body.lower(), "  " + body, body.upper(), " " * 300 + "Word"]
    rows = string_rows(spark, spark.createDataFrame([(t,) for t in texts] + [("Word",)], "v string"))["v"]
    assert rows.distinct_count == 6
    assert rows.lower_normalized_distinct == len({t.lower() for t in texts + ["Word"]})
    assert rows.whitespace_normalized_distinct == len({t.strip(" ") for t in texts + ["Word"]})
    assert rows.max_length == max(len(t.rstrip(" ")) for t in texts)
    assert sorted(rows.sample_values) == sorted(texts + ["Word"])


def test_samples_are_whole_and_distinct(spark):
    random.seed(3)
    texts = ["".join(random.choices("abc ", k=random.choice([3, 400]))) for _ in range(60)]
    c, values, columns = profiled(spark, spark.createDataFrame([(t,) for t in texts], "v string"))
    found = [r["sample"] for r in sample_values(values, columns, c).orderBy("rank").collect()]
    assert len(found) == len(set(found)) == min(20, len(set(texts)))
    assert set(found) <= set(texts)


def test_hot_value_is_one_row(spark):
    """A third of all rows share one value, number or long text."""
    hot = "hot text " * 50
    frame = spark.range(9000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("n"),
        F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id").cast("string")).alias("s"),
    )
    c, values, columns = profiled(spark, frame)
    best = {r.column_name: r for r in top_values(values, columns, c, 1).collect()}
    assert (best["n"].value_long, best["n"].cnt) == (-1, 3000)
    assert (best["s"].value_str, best["s"].cnt) == (hot, 3000)
    rows = {r.column_name: r for r in column_profiles(values, columns).collect()}
    assert rows["n"].distinct_count == rows["s"].distinct_count == 6001


def test_wide_decimals_keep_their_range(spark):
    def ends(kind, *texts):
        frame = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast(kind).alias("d"))
        c, values, columns = profiled(spark, frame)
        row = column_profiles(values, columns).first()
        return row.min_dec, row.max_dec, row.min_num, row.max_num, row.min_long

    assert ends("decimal(38,0)", "7", "12345678901234567891", "12345678901234567893") == (
        "7", "12345678901234567893", 7.0, 12345678901234567893.0, None,
    )
    assert ends("decimal(38,18)", "99999.123456789012345678", "0.5", None)[:2] == ("0.5", "99999.123456789012345678")
    negative = ("-12.000000000000000001", "-12", "-12.5", "-3.100000000000000007", "-3.100000000000000009")
    assert ends("decimal(38,18)", *negative)[:2] == ("-12.5", "-3.100000000000000007")
    assert ends("decimal(10,2)", "3", "10", "-2")[:2] == ("-2", "10")


def test_wide_decimals_overflow_nothing(spark):
    """A caught overflow costs some thirty microseconds a value."""
    cases = {
        (38, 0): ("9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "0", None),
        (38, 2): ("9223372036854775807.00", "9223372036854775808.00", "10.50", "100.00", "9223372036854775807.01"),
        (38, 20): ("100.00000000000000000001", "100.00000000000000000010", "0.00000000000000000001", "7"),
        (18, 2): ("9999999999999999.99", "-3.00"),
    }
    for (precision, scale), texts in cases.items():
        kind = T.DecimalType(precision, scale)
        keys = values_module._keys("d", kind, False)
        assert "try_cast(d AS BIGINT)" not in keys["k_num"]
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").cast(kind).alias("d"))
        for row in rows.selectExpr("t", *[f"{expression} AS {name}" for name, expression in keys.items()]).collect():
            value = row.t and Decimal(row.t)
            if value is None:
                expected = (None, None, None)
            elif value == int(value) and -(2**63) <= value < 2**63:
                expected = (int(value), None, None)
            elif Decimal(repr(float(value))) == value and abs(float(value)) < 10 ** (precision - scale):
                expected = (None, float(value), None)
            else:
                plain = f"{value:f}"
                expected = (None, None, plain.rstrip("0").rstrip(".") if "." in plain else plain)
            assert (row.k_num, row.k_dbl, row.k_txt) == expected, row.t


def test_texts_that_look_like_digests(spark):
    long = "x" * 300
    import hashlib

    fake = "sha256:" + hashlib.sha256(long.encode()).hexdigest()
    c, values, columns = profiled(spark, spark.createDataFrame([(long,), (fake,), ("sha256:",)], "t string"))
    assert column_profiles(values, columns).first().distinct_count == 3
    assert {r["sample"] for r in sample_values(values, columns, c).collect()} == {long, fake, "sha256:"}


def test_samples_do_not_depend_on_length(spark):
    import hashlib

    texts = [chr(97 + n) * (10 if n % 2 else 400) for n in range(26)]
    c, values, columns = profiled(spark, spark.createDataFrame([(t,) for t in texts], "t string"))
    found = [r["sample"] for r in sample_values(values, columns, c, 5).orderBy("rank").collect()]
    assert found == sorted(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest())[:5]


def test_column_names_with_backticks(spark):
    c, values, columns = profiled(spark, spark.createDataFrame([("a",)], "`odd``name` string"))
    assert column_profiles(values, columns).first().distinct_count == 1


def test_string_statistics_have_no_expand(spark):
    from tieweave.operators.strings import string_statistics

    _, values, columns = profiled(spark, spark.createDataFrame([("a ",), ("A",)], "t string"))
    found = string_statistics(values, columns)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert (found.first().whitespace_normalized_distinct, found.first().lower_normalized_distinct) == (2, 2)


def test_a_sample_of_files_reads_only_these(spark, tmp_path):
    spark.range(0, 8000, 1, 40).withColumn("b c", F.col("id") % 9).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    c = Catalog(spark, {"t.t": stored, "t.made": stored.groupBy("id").count()})
    config = Config(mode_a_max_rows=10, sample_fraction=0.25, sample_by="files")
    modes = profiling_modes(c.columns_frame(), c.row_counts(), config)
    scans = sampled_scans(c, modes, config)
    found = sorted(r.id for r in scans["t.t"].collect())
    assert 0.1 * 8000 < len(found) < 0.45 * 8000 and len(found) % 200 == 0
    assert found == sorted(r.id for r in sampled_scans(c, modes, config)["t.t"].collect())
    assert 1000 < scans["t.made"].count() < 3000  # by rows
    plan = scans["t.t"]._jdf.queryExecution().executedPlan()  # as collected above
    read = plan.collectLeaves().head().metrics()
    assert read.apply("numFiles").value() == len(found) // 200
    assert read.apply("numOutputRows").value() == len(found)
    # However small the share, one file is read.
    few = sampled_scans(c, modes, Config(mode_a_max_rows=10, sample_fraction=1e-9, sample_by="files"))
    assert few["t.t"].count() == 200
