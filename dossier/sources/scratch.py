"""Tables that a job writes for itself, in the folder that the cluster names for them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one of our own only where none is set and all runs on this machine, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-dossier-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dossier-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table of its own: cuts lineage, and outlives the executors that made it."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


@contextmanager
def folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder that is deleted at the end, also after a failure."""
    path = new_folder(spark, name)
    try:
        yield path
    finally:
        removed(spark, path)


def prepare(spark: SparkSession) -> None:
    """This package on executors that haven't installed it; once for a session, whoever asks first."""
    context, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_dossier_shipped", False):
        return
    name = Path(tempfile.mkdtemp(prefix="spark-dossier-")) / f"{top.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(name))
    context._dossier_shipped = True
