"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release, small


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b), as a written table: component is the smallest id that links reach.

    A round sends every id to the smallest of itself and its neighbours and rewrites the edges through
    that map, which keeps what is connected; the smallest id of a component always stays itself. Rounds
    go on until no edge joins two ids; the number of edges falls in each. All tables stay distributed,
    each round's edges are written to the shared folder and removed in the end, and every grouping is a
    minimum, which Spark computes partly before it shuffles.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rounds = [cut_lineage(ordered)]
    maps: list[DataFrame] = []
    while not rounds[-1].isEmpty():
        edges = rounds[-1]
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        maps.append(cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "id")))
        step = small(maps[-1])
        moved = (
            edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("p")), "a")
            .join(step.select(F.col("id").alias("b"), F.col("to").alias("q")), "b")
            .where("p <> q")
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .distinct()
        )
        rounds.append(cut_lineage(moved))

    def through(found: DataFrame, step: DataFrame) -> DataFrame:
        nxt = small(step).select(F.col("id").alias("component"), F.col("to").alias("further"))
        return found.join(nxt, "component", "left").select("id", F.coalesce("further", "component").alias("component"))

    if maps:
        found = reduce(through, maps[1:], maps[0].withColumnRenamed("to", "component"))
    else:
        found = rounds[0].select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = cut_lineage(found)
    release(*rounds, *maps)
    return out
