"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_FALLBACKS: dict[str, str] = {}


def local_session(app: str = "emberlane", cores: str | int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: on a cluster
    it would be visible to one machine only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    # Remembered here, as a running session's settings of this kind cannot be changed.
    application = spark.sparkContext.applicationId
    if application not in _FALLBACKS:
        _FALLBACKS[application] = tempfile.mkdtemp(prefix="emberlane-")
    return _FALLBACKS[application]


def run_folder(spark: SparkSession) -> str:
    """The folder of everything that this application writes on the way."""
    return f"{shared_dir(spark)}/emberlane/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete what this application has written on the way. Results that were not saved elsewhere cannot be read after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the run's folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    For results that several later jobs read (training sets, zip features): the
    lineage ends here, so a lost executor costs a re-read and not a re-run of
    the scans, and the columnar copy keeps column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
