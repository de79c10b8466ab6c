"""Connected components of an edge list by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).distinct()
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)


#: Edges up to which one task does the steps (some MB); beyond, they are shuffled.
SMALL = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b) that are not the smallest of their component.

    Each step links neighbours to the smallest of them and keeps the components; steps end when nothing changes.
    The minimum of a node's neighbours is combined before the shuffle, so a node with very many is no burden.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before, small = None, e.count() <= SMALL
    while True:
        e = written(_small(_large(e.coalesce(1) if small else e)).where("u <> v").distinct(), "components")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(now)
