"""Session helpers that every part of the library shares."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: set[str] = set()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    target = Path(tempfile.mkdtemp(prefix="codeloom-")) / "codeloom.zip"
    target.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's, the session's checkpoint folder, or in local mode, where all
    share one disk, one of our own that goes when the process ends. A cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        own = f"/tmp/checkpoints/codeloom-{os.getpid()}"
        if own not in _OWN:
            _OWN.add(own)
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        return f"file://{own}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # the write's exchanges are of no use once it is done
    try:
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def by_shuffle(df: DataFrame) -> DataFrame:
    """One side of a join that isn't to be broadcast: of all classes, say. A file's size tells little of it: names that 5 MB of Parquet
    are made into were 192 MB in the driver."""
    return df.hint("merge")


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing reads any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
