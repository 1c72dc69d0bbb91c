"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback_dirs: dict[str, str] = {}


def local_session(cores: str = "8", app: str = "lamina") -> SparkSession:
    """A local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: ``spark.checkpoint.dir`` if the cluster sets it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback_dirs[app]


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a local checkpoint the result survives the loss of an executor, and
    unlike an RDD checkpoint it has file statistics and can be pruned.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/lamina-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a stored table may be sent to all tasks.
FEW = 1 << 18


def materialize(df: DataFrame, codec: str | None = None, few: int = FEW) -> DataFrame:
    """``stored``, but never broadcast with more than ``few`` rows.

    Spark takes a stored table for as small as its files.  Pixels and runs are
    a hundred times smaller there than as rows in the driver, which collects a
    table before it sends it to all.  Rows are counted from the file footers.
    """
    out = stored(df, codec)
    return out.hint("merge") if out.count() > few else out


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), os.path.basename(here))
    archive = shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
