"""Session defaults and the shared folder that long plans are cut in."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a session should have; a cluster's own settings win over them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("callgrain")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset in a local session (tests), one of this machine.

    A session on a cluster without that setting is refused: its executors would each write to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="callgrain-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back, so that its lineage ends there.

    Every executor can read the table again after a loss. The table is removed by `forget_cuts`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/callgrain/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_held: list[tuple[SparkSession, str]] = []


def forget_cuts() -> None:
    """Remove all tables cut so far; frames that read them can't be used any more."""
    while _held:
        _drop(*_held.pop())


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    if not _held:
        pid = os.getpid()
        atexit.register(lambda: forget_cuts() if os.getpid() == pid else None)
    _held.append((spark, path))
