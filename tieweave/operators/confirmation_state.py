"""Who confirmed what, kept as a table that batches of the log are folded into exactly once."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tieweave.operators.stored_graphs import SIGNATURE

PAIR = (*SIGNATURE, "session_id")
SCHEMA = ", ".join(f"{name} string" for name in PAIR) + ", batch_id string"


def state(spark: SparkSession, folder: str) -> DataFrame:
    """(signature, session_id, batch_id): each pair once, in the batch that brought it first."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{folder}/pairs")
    except AnalysisException as error:  # the folder is written by the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SCHEMA)


def fold(log: DataFrame, folder: str, batch_id: str) -> None:
    """Adds the pairs of one batch of the log that no other batch has brought.

    The batch's own partition is overwritten and never looked at, so a batch that comes again, after a
    failure or by mistake, leaves the state as it was.  A null in a signature or session is a value like others.
    A task that runs again writes the same rows.  Batches are folded one after the other.
    """
    known = state(log.sparkSession, folder).where(F.col("batch_id") != batch_id).alias("had")
    new = log.select(*PAIR).distinct().alias("new")
    same = reduce(and_, [F.col(f"new.{name}").eqNullSafe(F.col(f"had.{name}")) for name in PAIR])
    fresh = new.join(known, same, "left_anti").withColumn("batch_id", F.lit(batch_id))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(
        f"{folder}/pairs"
    )


def fold_folder(spark: SparkSession, log_folder: str, schema: StructType, folder: str, files: int = 1000) -> None:
    """Folds what is new in a folder of log files, ``files`` a batch, and returns.

    The stream's checkpoint below ``folder`` knows which files are folded; a batch that failed half-way
    comes again under its number.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(log_folder)
    query = (
        rows.writeStream.foreachBatch(lambda batch, number: fold(batch, folder, f"stream-{number}"))
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def session_counts(pairs: DataFrame) -> DataFrame:
    """Sessions by signature.  Pairs are distinct already, so this is a plain count, combined in each task."""
    return pairs.groupBy(*SIGNATURE).agg(F.count(F.lit(1)).alias("sessions"))
