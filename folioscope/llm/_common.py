"""Columns and connected components that the operators of this subpackage share; scratch tables come from the library."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.scratch import checked, drop, only, table  # noqa: F401  also for the operators

#: The id that stands for a null one inside the operators: it sorts after all others.
NO_ID = (1 << 63) - 1
#: What separates words: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to this many edges (16 bytes each) are joined in the driver; more by rounds over the cluster.
FEW_EDGES = 20_000


def beside(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the corpus: it is shuffled and merged at every size, never broadcast."""
    return df.hint("merge")


def at_hand(df: DataFrame) -> DataFrame:
    """df, a frame that ``table`` returned, as a side of a join: sent to all tasks if it is ``checked`` to be small, else ``beside``."""
    small = checked(df)
    return beside(df) if small is df else small


def lower_ascii(c: Column) -> Column:
    """c with A-Z, and nothing else, in lower case.  ``lower`` does that for texts of ASCII characters only."""
    slow = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(slow)


def text_hash(c: Column) -> list[Column]:
    """128 bits of a text in two longs, t1 and t2."""
    return [F.xxhash64(c).alias("t1"), F.xxhash64(F.lit(1), c).alias("t2")]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.  Only nodes with an edge are returned.

    Large-star and small-star rounds: each turns the edges into ones that point to smaller nodes until all point to
    their component's smallest.  A hub is never gathered: each round needs a minimum per node (pre-aggregated) and a
    join whose hot side Spark can split.  Edges that are stars already, as of an earlier call, take fewer rounds.  Up to
    `few` edges take none: a round costs its tasks' start, however little there is to do.
    """
    e = table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    if e.count() <= few:
        return _united(e)
    for _ in range(rounds):
        if _settled(e):
            break
        # large star: link every larger neighbour of a node to the least in its neighbourhood; repeats go at the round's end
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: link every smaller neighbour, and the node itself, to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        old, e = e, table(nxt.distinct(), "edges")
        drop(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _united(e: DataFrame) -> DataFrame:
    """(node, component) of few edges u > v, by union and find in the driver."""
    found = e.toArrow()
    up: dict = {}

    def least(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in zip(found["u"].to_pylist(), found["v"].to_pylist(), strict=True):
        u, v = least(u), least(v)
        up[max(u, v)] = min(u, v)
    kind = found.schema.field("u").type
    return e.sparkSession.createDataFrame(pa.table({"node": pa.array(list(up), kind), "component": pa.array([least(x) for x in up], kind)}))


def _settled(e: DataFrame) -> bool:
    """Whether edges u > v are stars: no node has two smaller ones, and none that has one is another's."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    told = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return told.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0] == 0
