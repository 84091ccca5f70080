"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeboard.sources.storage import release, write_and_reload


def _least(edges: DataFrame, keep) -> DataFrame:
    """For each ``u`` its least neighbour or itself; the hub's edges are combined before they are shuffled."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("least", "u"))
    return edges.where(keep).join(least, "u")


def _resolved(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v``, and no ``v`` is a ``u``: each edge then names the component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up")))
    return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where(
        (F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) for every id that has a link; the component is its smallest id.

    Every round is written to the shared folder, and removed once the next one
    is; the number of rounds grows with the logarithm of a component's size.
    Rounds end as soon as every id points to one that points nowhere.
    The result is written too (``storage.release`` removes it).
    """
    edges = write_and_reload(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")   # u > v: each edge points to a smaller id
    while not _resolved(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        least = _least(large.where("u <> v").distinct(), F.lit(True))
        small = least.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            least.select("u", F.col("least").alias("v")))
        latest = write_and_reload(small.where("u <> v").distinct(), "components")
        release(edges)
        edges = latest
    groups = write_and_reload(edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()), "components-done")
    release(edges)
    return groups
