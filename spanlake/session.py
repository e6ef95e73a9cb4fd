"""Session defaults and the one place that materialises intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the size-checked decisions: broadcast below the threshold, skewed
# partitions split, tiny ones coalesced. Nothing in the library forces a broadcast of data that grows.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Stand-in folders of local sessions, by application id.
_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app_name: str = "spanlake", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session. ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config(
                "spark.ui.showConsoleProgress", "false"
            ).config("spark.driver.memory", "12g")
    for key, value in {**_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="spanlake-")
    return _LOCAL_FOLDERS[application]


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    """Write ``df`` as parquet, tightly packed. What its plan shuffled is removed when it is written; else it would lie on
    the executors' disks until the driver happens to collect its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so later stages neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)
