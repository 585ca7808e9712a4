"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fernbrand")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) a local temporary folder is set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "fernbrand-checkpoints"))
    return context.getCheckpointDir()


_WRITTEN: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder belongs to it
            pass


def release() -> None:
    """Removes the scratch tables written so far. What was made from them can't be read any more, so
    a long session calls this between jobs, after results are written."""
    _remove_written()
    _WRITTEN.clear()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it from there.

    The copy outlives lost executors, and later actions don't run what came before it again. It
    is a compressed columnar table, removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/fernbrand-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
