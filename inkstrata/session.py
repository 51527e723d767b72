"""A session with the settings that results depend on, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(name: str = "inkstrata", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers by way of the shared folder, for clusters where it isn't installed. Once a session."""
    if (app := spark.sparkContext.applicationId) not in _SHIPPED:
        package, packed = Path(__file__).parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted([*package.rglob("*.py"), *package.rglob("*.json")]):
                z.write(p, p.relative_to(package.parent))
        path = new_path(spark, "inkstrata") + ".zip"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.write(packed.getvalue())
        out.close()
        spark.sparkContext.addPyFile(path)
        remove_at_end(spark, path)
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` wins. Where it is unset, a local session takes a temporary folder (once a session)
    and a cluster takes the warehouse, which it shares anyway.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if spark.sparkContext.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="inkstrata-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            told = f"file://{folder}"
        else:
            told = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_inkstrata"
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Whatever is at ``path`` by now goes when the driver ends, in whichever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def stash(df: DataFrame, tag: str = "stash") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: a lineage cut that outlives any executor.

    The table is removed when the driver ends, as results may be computed from it until then.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    remove_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Removes tables that ``stash`` gave, once all that is computed from them has itself been written."""
    for df in stashed:
        if path := getattr(df, "_stashed", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer input splits than cores (one small file, say) is dealt over all cores; larger ones are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
