"""Connected components of an edge table by alternating large-star and small-star steps; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import cut, discard


#: Parts that the neighbours of a node are dealt to, so that a hub's are not all in one task.
PARTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``u, v`` with the ``m`` of ``u``."""
    parts = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).join(parts, ["u", "part"])


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = _with_least(down, least).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b`` of one orderable type); ``root`` is the least node of its component.

    Loops and repeated edges are ignored; no edges give no rows. The result is a written table.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        new = cut(_small(_large(now).distinct()).where("a <> b").distinct())
        discard(now)
        now, last, mark = new, mark, _mark(new)
        if tuple(mark) == tuple(last):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
