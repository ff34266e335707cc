"""Session construction and the shared folder that operators checkpoint to."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "labspark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset.

    The fallback serves local sessions, where driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    """A folder for this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="labspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and leaves the reader free to
    prune columns and to plan joins on fresh statistics.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/labspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: The tables that materialise wrote and nothing removed yet.
_tables: list[str] = []


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialise returned, once no later step reads them."""
    for df in tables:
        _remove(df.sparkSession, df._written_to)


def release(spark: SparkSession) -> None:
    """Removes all tables that materialise wrote in this process: to be called when results are written."""
    for path in list(_tables):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    if path in _tables:
        _tables.remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
