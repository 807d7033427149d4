import random

from pyspark.sql import functions as F

from tieweave.operators import estimates
from tieweave.operators.profiles import column_profiles
from tieweave.operators.values import value_counts
from tieweave.sources.catalog import Catalog


def sides(spark):
    rng = random.Random(1)
    a = spark.range(0, 60_000).select("id", (F.col("id") % 500).alias("few"), F.expr("if(id % 3 = 0, NULL, cast(id AS string))").alias("name"))
    b = spark.range(30_000, 80_000).select((F.col("id").cast("double")).alias("id"), F.lit(rng.random()).alias("one"))
    return Catalog(spark, {"t.a": a, "t.b": b})


def test_errors_against_exact_profiles(spark):
    c = sides(spark)
    exact = {r.col_id: r for r in column_profiles(value_counts(c), c.columns_frame()).collect()}
    found = {r.col_id: r for r in estimates.estimated_profiles(estimates.column_sketches(c)).collect()}
    assert found.keys() == exact.keys()
    for n, r in found.items():
        assert (r.row_count, r.non_null_count, r.mode) == (exact[n].row_count, exact[n].non_null_count, "estimate")
        assert r.null_ratio == (r.row_count - r.non_null_count) / r.row_count
        assert r.exact == (exact[n].distinct_count < 8192)
        assert abs(r.distinct_estimate - exact[n].distinct_count) <= (0 if r.exact else 0.04 * exact[n].distinct_count)
        assert 0 <= r.unique_ratio <= 1


def test_overlap_across_types(spark):
    c = sides(spark)
    ids = {(r["table_key"], r["column_name"]): r["col_id"] for r in c.column_rows()}
    pairs = spark.createDataFrame([(ids["t.a", "id"], ids["t.b", "id"]), (ids["t.a", "few"], ids["t.b", "one"])], "source_col int, target_col int")
    found = {r.source_col: r for r in estimates.estimated_overlaps(pairs, estimates.column_sketches(c)).collect()}
    ids_met = found[ids["t.a", "id"]]
    assert abs(ids_met.shared_estimate - 30_000) < 0.06 * 30_000 and abs(ids_met.union_estimate - 80_000) < 0.04 * 80_000
    few = found[ids["t.a", "few"]]
    assert few.exact and few.shared_estimate == 0 and few.union_estimate == 501


def test_new_files_are_scanned_alone(spark, tmp_path):
    folder, store = str(tmp_path / "table"), str(tmp_path / "store")
    assert estimates.stored(spark, store).count() == 0
    spark.range(0, 3000, 1, 2).withColumn("_file x", F.col("id") % 7).write.parquet(folder)
    assert estimates.fold_files(spark, folder, store) == 2
    assert estimates.fold_files(spark, folder, store) == 0
    before = {(r.file, r.column_name) for r in estimates.stored(spark, store).collect()}
    spark.range(2000, 5000, 1, 1).withColumn("_file x", F.lit(None).cast("long")).write.mode("append").parquet(folder)
    assert estimates.fold_files(spark, folder, store) == 1
    assert before < {(r.file, r.column_name) for r in estimates.stored(spark, store).collect()}
    rows = estimates.estimated_profiles(estimates.merged(estimates.stored(spark, store), "column_name")).collect()
    found = {r.column_name: (r.row_count, r.non_null_count, r.distinct_estimate) for r in rows}
    assert found == {"id": (6000, 6000, 5000), "_file x": (6000, 3000, 7)}


def test_empty_tables(spark, tmp_path):
    c = Catalog(spark, {"t.e": spark.createDataFrame([], "a int")})
    assert estimates.column_sketches(c).collect() == []
    folder, store = str(tmp_path / "table"), str(tmp_path / "store")
    spark.createDataFrame([], "a int").write.parquet(folder)
    files = estimates.fold_files(spark, folder, store)
    assert estimates.fold_files(spark, folder, store) == 0
    assert estimates.merged(estimates.stored(spark, store), "column_name").collect() == [] and files <= 1
