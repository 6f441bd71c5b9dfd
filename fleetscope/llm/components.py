"""Connected components of an edge table by alternating large stars and small stars.

Every step is joins and aggregations and ends in a written table; the driver loops over steps and sees counts only. A step
has as many tasks as its rows need (:func:`..skew.few`), and the steps end as soon as all edges are stars.
A node with a third of all edges is no hot task: minima are aggregated before the shuffle and joined back by
:func:`..skew.attach`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .skew import attach, few
from .store import dropped, written


def _stars(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """``edges`` (u > v; ``most`` rows at most). Large star: all neighbours above a node are tied to its least neighbour (some
    perhaps twice); small star: those below, and the node itself."""
    down = edges.select("u", "v")
    both = down.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    rows = most * 2 if large else most
    least = few(both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")).withColumn("_m", F.least("_m", "u")), rows)
    tied = attach(both, least, ["u"], "_n", rows)
    if large:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        return few(out.filter(F.col("u") != F.col("v")), most)
    out = tied.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(tied.select("u", F.col("_m").alias("v")))
    return few(few(out.filter(F.col("u") != F.col("v")), rows).distinct(), rows)


def _state(edges: DataFrame, most: int) -> Row:
    """Of distinct ``edges`` (u > v): their number ``n``, and whether they are still ``open`` (no stars: a node has two edges
    down, or edges both ways)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("d")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("d")))
    nodes = few(ends.groupBy("node").agg(F.sum("d").alias("down"), F.count(F.lit(1)).alias("all")), 2 * most)
    tangled = (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("all") > F.col("down")))
    return nodes.agg(F.coalesce(F.sum("down"), F.lit(0)).alias("n"), F.coalesce(F.max(tangled), F.lit(False)).alias("open")).first()


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): node, label (the least node that it reaches) for each node that has an edge."""
    pairs = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = written(few(pairs.distinct(), edges.count()), "edges")
    state = _state(now, now.count())
    while state.open:
        # a large star has no more rows than its edges, so their number bounds what the small star reads
        wide = written(_stars(now, True, state.n), "large-star")
        dropped(now)
        now = written(_stars(wide, False, state.n), "small-star")
        dropped(wide)
        state = _state(now, 2 * state.n)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(few(roots, state.n))
