"""Trees of (id, parent): closures, counts of descendants, paths and filters that keep ancestors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.sources.scratch import folder, new_folder, written


def closure(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(ancestor, descendant, distance): every node with itself and all that is above it, once, at the least distance.

    A parent that isn't a node ends a path; so does a circle, where no pair is new.  Distances double each round: the
    pairs at exactly the greatest distance so far are joined with all pairs above them, and what comes of a round is
    written to a folder that is deleted at the end, so neither rows nor levels are limited.  The result is a table in spark.checkpoint.dir.
    """
    spark = nodes.sparkSession
    with folder(spark, "closure") as base:
        put = lambda df, name: written(df, f"{base}/{name}")
        given = put(nodes.select(F.col(node).alias("id"), F.col(parent).alias("up")).distinct(), "given")
        ids = given.select("id").distinct()
        own = ids.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("distance"))
        edges = given.join(ids.select(F.col("id").alias("ancestor")), F.col("up") == F.col("ancestor")).where("id != up")
        above = [put(edges.select("ancestor", F.col("id").alias("descendant"), F.lit(1).alias("distance")), 1)]
        reach = 1
        while not above[-1].isEmpty():
            pairs = reduce(DataFrame.union, above)
            # A shortest path of more than `reach` steps has a node after exactly `reach` of them.
            lower = above[-1].where(F.col("distance") == reach).select(F.col("ancestor").alias("middle"), "descendant")
            upper = pairs.select("ancestor", F.col("descendant").alias("middle"), "distance")
            further = lower.join(upper, "middle").where("ancestor != descendant").groupBy("ancestor", "descendant").agg((F.min("distance") + reach).alias("distance"))
            reach *= 2
            above.append(put(further.join(pairs, ["ancestor", "descendant"], "left_anti"), reach))
        return written(reduce(DataFrame.union, [own, *above]), new_folder(spark, "pairs"))


def descendant_counts(pairs: DataFrame) -> DataFrame:
    """(id, descendants) from a closure; leaves have 0."""
    return pairs.groupBy(F.col("ancestor").alias("id")).agg((F.count("*") - 1).alias("descendants"))


def matching_branches(pairs: DataFrame, matches: DataFrame, node: str) -> DataFrame:
    """Ids that match or have a descendant that does."""
    hit = matches.select(F.col(node).alias("descendant"))
    return pairs.join(hit, "descendant", "left_semi").select(F.col("ancestor").alias("id")).distinct()
