"""Session helpers: shared folder, written tables and small bounded reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sembla", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; existing settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode.

    Outside local mode an unset folder is an error, as a folder of one machine
    would be unreadable from the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sembla-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_shipped: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Sends this package to the Python workers of a session (the active one), once, so that they needn't find it on a path of their own."""
    context = (spark or SparkSession.active()).sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sembla-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(f"{folder}/{root.name}.zip")


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, with the package sent along."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_pandas(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInPandas, with the package sent along."""
    ship_package(df.sparkSession)
    return df.mapInPandas(run, schema)


_kept: set[str] = set()


def _tables_dir(spark: SparkSession) -> str:
    """The folder of this application's written tables; it is deleted when the driver ends in order."""
    path = f"{shared_dir(spark)}/sembla-{spark.sparkContext.applicationId}"
    if path not in _kept:
        _kept.add(path)
        atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_table(spark, path)
    except Exception:  # the session may have ended before
        pass


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder; the table read back and its path.

    One file per partition, so that a range-sorted frame keeps its runs.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", 0).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the folder of this application's tables."""
    return f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of write_table; nothing happens if it is gone already."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table of a data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
