"""Session defaults and the shared folder that holds intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def build_session(app: str = "tieweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    if master and not master.startswith("local"):
        # AQE merges partitions that turn out small, but never splits an aggregation's.
        settings.setdefault("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "16384")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, which only local mode may leave it, a scratch one that goes with the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="tieweave-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return _own_folders[app]


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts the lineage, survives the loss of executors and keeps
    column pruning for its readers.  Its file sizes are known to Catalyst, so a later
    join broadcasts it only when those are below ``autoBroadcastJoinThreshold``.
    ``options`` are those of the writer.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/tieweave/{app}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_frame(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A small driver-side list as a LocalRelation, whose size Catalyst knows."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))
