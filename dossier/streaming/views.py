"""Views that grow with a stream: units grouped by file in the order in which files were first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_batch(target: str, order: str):
    """A function for foreachBatch: the units of a batch become the folder of the batch, whole or not at all.

    A batch that is run again takes the place of what it wrote, so it changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__order", F.col(order)).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={batch_id}")

    return merge


def follow(units: DataFrame, target: str, order: str, checkpoint: str) -> None:
    """Adds all that a stream of units has now."""
    units.writeStream.foreachBatch(merge_batch(target, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def grouped(units: DataFrame, file: str, page: str, columns: list[str]) -> DataFrame:
    """(file, place, units): files by the first batch and place that names them; units by page, those of the whole file first.

    units: what `follow` has written, read as a table.  Units of the same page keep the order in which they came.
    """
    unit = F.struct(F.coalesce(F.col(page), F.lit(-1)).alias("p"), "batch", F.col("__order").alias("o"), F.struct(page, *columns).alias("unit"))
    d = units.groupBy(file).agg(F.min(F.struct("batch", "__order")).alias("place"), F.transform(F.array_sort(F.collect_list(unit)), lambda u: u["unit"]).alias("units"))
    return d.select(file, F.struct(F.col("place.batch").alias("batch"), F.col("place.__order").alias("order")).alias("place"), "units")
