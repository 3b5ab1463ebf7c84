"""Files that the stages of a job share: written tables in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one of our own only where none is set and all runs on this machine, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-dossier-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and outlives the executors that made it.

    What was shuffled for it is deleted as soon as it has been written.  by: rows are bucketed by this column, as they
    come, so that joins by it don't move them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dossier-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        if by:
            table = "dossier_" + uuid.uuid4().hex
            writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).format("parquet").saveAsTable(table)
            out = spark.table(table)
            out.shared_table = table
        else:
            writer.parquet(path)
            out = spark.read.schema(df.schema).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out.shared_path = path
    return out


def removed(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more: what came of it has been written itself."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.shared_path)
    if hasattr(table, "shared_table"):
        spark.sql(f"DROP TABLE {table.shared_table}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def likely(rows: DataFrame, keys: DataFrame, column: str, per_key: int = 32, most: int = 2048) -> DataFrame:
    """rows with `likely`: true wherever keys have the row's `column` (a hash, long), and for about 1 in per_key of the others.

    The keys' bits are broadcast, at most `most` buckets of 4 KB (8 MB) whatever the number of keys, so that rows which
    no key can match aren't shuffled; a join with the keys is to follow.  Beyond `most` more of the others are true.
    """
    bucket_bits = 1 << 15
    buckets = min(most, max(1, -(-keys.count() * per_key // bucket_bits)))
    at = F.pmod(F.col(column), F.lit(buckets * bucket_bits))
    place = (at % bucket_bits).cast("int")
    bits = keys.groupBy(F.floor(at / bucket_bits).alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))
    found = rows.withColumn("bucket", F.floor(at / bucket_bits)).join(F.broadcast(bits), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, place % 8)
    return found.withColumn("likely", F.coalesce(bit == 1, F.lit(False))).select(*rows.columns, "likely")


def prepare(spark: SparkSession) -> None:
    """This package on executors that haven't installed it."""
    context, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_dossier_shipped", False):
        return
    name = Path(tempfile.mkdtemp(prefix="spark-dossier-")) / f"{top.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(name))
    context._dossier_shipped = True
