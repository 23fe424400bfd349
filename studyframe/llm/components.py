"""Connected components of an edge table, as joins and grouped minima; and pairs to try between the classes of overlapping groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyframe.llm.work import handed_off


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``edges`` (a, b): root is the least vertex of its component.

    Each round takes the least root among a vertex and its neighbours, then follows that root's own root, so chains halve. Minima are combined before the
    shuffle; a vertex with very many neighbours only makes a skewed join, which adaptive execution splits. Tables are handed over between rounds.
    """
    both = edges.select(F.col("a").alias("vertex"), F.col("b").alias("near")).unionAll(edges.select(F.col("b").alias("vertex"), F.col("a").alias("near")))
    both = handed_off(both.distinct(), "edges")
    roots = handed_off(both.groupBy("vertex").agg(F.min("near").alias("near")).select("vertex", F.least("vertex", "near").alias("root")), "roots")
    while True:
        around = (both.join(roots.select(F.col("vertex").alias("near"), F.col("root").alias("other")), "near")
                  .groupBy("vertex").agg(F.min("other").alias("other")))
        lower = roots.join(around, "vertex").select("vertex", "root", F.least("root", "other").alias("low"))
        jump = roots.select(F.col("vertex").alias("low"), F.col("root").alias("beyond"))
        after = handed_off(lower.join(jump, "low", "left").select("vertex", "root", F.least("low", "beyond").alias("new")), "roots")
        if after.filter("root <> new").isEmpty():
            return roots
        roots = after.select("vertex", F.col("new").alias("root"))


def apart(lists: DataFrame, classes: DataFrame | None) -> DataFrame:
    """The rows of ``lists`` (key, node, ...) whose key still holds several classes, with the ``class`` of each node; ``classes`` has (node, class), other nodes are their own."""
    own = lists.select("*", F.col("node").alias("class"))
    if classes is not None:
        known = classes.select("node", F.col("class").alias("_class"))
        own = lists.join(known, "node", "left").select(*lists.columns, F.coalesce("_class", "node").alias("class"))
    several = own.groupBy("key").agg(F.min("class").alias("one"), F.max("class").alias("two")).filter("one <> two").select("key")
    return handed_off(own.join(several, "key"), "lists")


def led(lists: DataFrame, turn: int, fits: Column | None = None, first: str | None = None) -> DataFrame:
    """(a, b): each node with at most one node of another class, the least leader of its keys in the order of this turn.

    ``fits`` is a condition on the row and on ``lead``, the leader's row. Nodes with the least ``first`` lead before others. One pair a node joins a group of any size to its leader.
    """
    place = F.xxhash64("node", F.lit(turn))
    rest = [c for c in lists.columns if c not in ("key", "node", first)]
    leader = lists.groupBy("key").agg(F.min(F.struct(*([first] if first else []), place.alias("place"), F.col("node"), *rest)).alias("lead"))
    met = lists.join(leader, "key").filter(F.col("class") != F.col("lead.class"))
    met = (met if fits is None else met.filter(fits)).groupBy("node").agg(F.min("lead").alias("lead"))
    return pairs(met.select("node", F.col("lead.node").alias("near")))


def pairs(found: DataFrame) -> DataFrame:
    """(a, b) with a < b from (node, near), each once."""
    return found.filter("node <> near").select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct()
