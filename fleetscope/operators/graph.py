"""Graph operators (J16, J17, J20, E3, W5): blocking chains, dependency levels,
global sequences.

Recursion is level-synchronous: each level is one distributed join of the
current frontier with the edge list, so the driver loop runs once per *level*
(until a level adds nothing), never per row. Frontiers are checkpointed into the
shared checkpoint folder so lineage stays short and a lost executor only
recomputes the current level.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path
from .joins import shuffle_partitions

# Blocking tree label pieces.
TREE_PREFIX = "    \u00a0\u00a0"
TREE_INDENT = "|         "
TREE_HEAD = "HEAD BLOCKER -  "
TREE_CHILD = "|------  "
SYSTEM_SPID_MAX = 50


def _cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def global_sequence(df: DataFrame, group: str, order: Sequence[str], alias: str = "sequence") -> DataFrame:
    """A global 1..N numbering ordered by (group, *order) without a single-partition window.

    Rows are range-partitioned on the ordering, numbered within each range
    partition and shifted by the row counts of the preceding partitions (a
    table with one row per partition). No group, however large, lands in one
    task.
    """
    from .events import dense_rank_global

    return dense_rank_global(df, [group, *order], alias=alias, distinct_keys=False)


def blocking_chains(edges: DataFrame, start=None, end=None, max_depth: int | None = None,
                    time_col: str = "event_time") -> DataFrame:
    """Blocking chains per monitor loop (E3, J16, U-3, J12).

    ``edges``: monitor_loop, blocked_spid, blocked_ecid, blocking_spid,
    blocking_ecid, event_time, plus detail columns (lock_mode, database_name,
    blocking_duration_ms). Heads are blockers that are not blocked in the same
    loop; the chain follows blocked -> blocking. A node already on its path is
    not revisited (cycle guard), so the walk ends when a level adds no node;
    ``max_depth`` (default: none) only bounds it on request. Output per node: monitor_loop, session_id,
    ecid, blocking_session_id (NULL for heads), blocking_level, blocking_chain
    ('/spid.ecid/...'), blocking_tree label, event details (heads take them from
    their earliest blocking edge), and a global ``sequence`` by (loop, chain).
    """
    e = edges
    if start is not None:
        e = e.filter(F.col(time_col) >= F.lit(start))
    if end is not None:
        e = e.filter(F.col(time_col) <= F.lit(end))
    node = ["monitor_loop", "session_id", "ecid"]
    blockers = e.select("monitor_loop", F.col("blocking_spid").alias("session_id"),
                        F.col("blocking_ecid").alias("ecid"))
    blocked = e.select("monitor_loop", F.col("blocked_spid").alias("session_id"),
                       F.col("blocked_ecid").alias("ecid"))
    heads = blockers.subtract(blocked)

    def path_piece(s, c):
        return F.concat(s.cast("string"), F.lit("."), c.cast("string"), F.lit("/"))

    level = heads.select(*node, F.concat(F.lit("/"), path_piece(F.col("session_id"), F.col("ecid"))).alias("blocking_chain"),
                         F.lit(None).cast("int").alias("blocking_spid"), F.lit(None).cast("int").alias("blocking_ecid"),
                         F.lit(0).alias("blocking_level"))
    level = _cut(level)
    levels = [level]
    # the edge list is joined once per level: materialise it once
    # hash-partitioned by the join key before the checkpoint, so the per-level joins reuse it
    step = _cut(e.select("monitor_loop", "blocked_spid", "blocked_ecid",
                         F.col("blocking_spid").alias("_p_spid"), F.col("blocking_ecid").alias("_p_ecid")).distinct()
                .repartition("monitor_loop", "_p_spid", "_p_ecid"))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = (level.join(step, (level.monitor_loop == step.monitor_loop) & (level.session_id == step._p_spid)
                          & (level.ecid == step._p_ecid))
               .select(level.monitor_loop, F.col("blocked_spid").alias("session_id"),
                       F.col("blocked_ecid").alias("ecid"),
                       F.concat(F.col("blocking_chain"), path_piece(F.col("blocked_spid"), F.col("blocked_ecid")))
                        .alias("blocking_chain"),
                       F.col("_p_spid").alias("blocking_spid"), F.col("_p_ecid").alias("blocking_ecid"),
                       F.lit(depth).alias("blocking_level"),
                       F.col("blocking_chain").alias("_parent_chain")))
        # cycle guard: the node must not already be on its parent's path
        nxt = nxt.filter(~F.col("_parent_chain").contains(
            F.concat(F.lit("/"), path_piece(F.col("session_id"), F.col("ecid"))))).drop("_parent_chain")
        nxt = _cut(nxt)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        level = nxt
    h = levels[0]
    for lv in levels[1:]:
        h = h.unionByName(lv)

    detail_cols = [c for c in e.columns if c not in ("monitor_loop", "blocked_spid", "blocked_ecid",
                                                      "blocking_spid", "blocking_ecid")]
    # details of the blocked process: the edge where the node is blocked by its parent
    bproc = e.select(F.col("monitor_loop"), F.col("blocked_spid").alias("session_id"),
                     F.col("blocked_ecid").alias("ecid"), "blocking_spid", "blocking_ecid", *detail_cols)
    pkey = node + ["blocking_spid", "blocking_ecid"]
    bproc = (bproc.groupBy(*pkey)
             .agg(F.min_by(F.struct(*detail_cols), F.struct(time_col, *[c for c in detail_cols if c != time_col]))
                  .alias("_d")))
    # details of a head: its earliest blocking edge (declared order; the original took any row)
    bhead = (e.groupBy("monitor_loop", F.col("blocking_spid").alias("session_id"), F.col("blocking_ecid").alias("ecid"))
             .agg(F.min_by(F.struct(*detail_cols), F.struct(time_col, "blocked_spid", "blocked_ecid")).alias("_h")))
    j = h.join(bproc, pkey, "left")
    j = j.join(bhead, node, "left")
    details = [F.when(F.col("blocking_level") == 0, F.col(f"_h.{c}")).otherwise(F.col(f"_d.{c}")).alias(c)
               for c in detail_cols]
    tree = F.concat(
        F.lit(TREE_PREFIX), F.repeat(F.lit(TREE_INDENT), F.col("blocking_level")),
        F.when(F.col("blocking_level") == 0, F.lit(TREE_HEAD)).otherwise(F.lit(TREE_CHILD)),
        F.lit("SPID "), F.when(F.col("session_id") <= SYSTEM_SPID_MAX, F.lit("(SYSTEM)")).otherwise(F.lit("")),
        F.lit(": "), F.col("session_id").cast("string"))
    out = j.select("monitor_loop", "session_id", "ecid",
                   F.col("blocking_spid").alias("blocking_session_id"),
                   "blocking_level", "blocking_chain", tree.alias("blocking_tree"), *details)
    return global_sequence(out, "monitor_loop", ["blocking_chain"])


def dependency_levels(edges: DataFrame, child: str = "child", parent: str = "parent",
                      max_level: int | None = None) -> DataFrame:
    """Dependency level per node: 1 + the longest chain of parents above it.
    Nodes without parents are level 1; nodes on a cycle, or below one, have no
    longest chain and get level NULL.

    Layers are peeled off from the top: a node is settled in the round after the
    last of its parents, so each edge is joined once, and what is never settled
    is the cycles. Only nodes with some parents settled are carried between
    rounds; the edges are written once, bucketed by parent, and stay in place. ``max_level`` is a guard: reaching it fails the job.
    """
    spark = edges.sparkSession
    pairs = _cut(edges.select(F.col(child).alias("node"), F.col(parent).alias("_parent")).distinct())
    nodes = _cut(pairs.select("node").union(pairs.select(F.col("_parent").alias("node"))).distinct())
    due = _cut(pairs.groupBy("node").agg(F.count(F.lit(1)).alias("_due")))
    layer = _cut(nodes.join(due, "node", "left_anti"))
    layers = [layer.withColumn("level", F.lit(1))]
    # each edge brings its node's number of parents; bucketed by the join key, so that no round moves the edges again
    buckets = shuffle_partitions(spark)
    table, path = f"dependency_edges_{uuid.uuid4().hex}", scratch_path(spark, f"dependency-edges-{uuid.uuid4().hex}")
    (pairs.join(due, "node").repartition(buckets, "_parent").write.bucketBy(buckets, "_parent").format("parquet")
     .option("path", path).saveAsTable(table))
    ed = spark.table(table)
    waiting = ed.select("node", "_due", F.lit(0).cast("bigint").alias("_met")).limit(0)
    try:
        while True:
            met = (ed.join(layer.withColumnRenamed("node", "_parent"), "_parent")
                   .groupBy("node", "_due").agg(F.count(F.lit(1)).alias("_met")))
            met = _cut(waiting.unionByName(met).groupBy("node", "_due").agg(F.sum("_met").alias("_met")))
            layer = met.filter(F.col("_met") == F.col("_due")).select("node")
            if layer.isEmpty():
                break
            if max_level is not None and len(layers) >= max_level:
                raise ValueError(f"dependency chains are longer than max_level = {max_level}")
            layers.append(layer.withColumn("level", F.lit(len(layers) + 1)))
            waiting = met.filter(F.col("_met") < F.col("_due")).select("node", "_due", "_met")
    finally:
        spark.sql(f"DROP TABLE {table}")  # its files stay with the checkpoints
    settled = layers[0]
    for lv in layers[1:]:
        settled = settled.unionByName(lv)
    return nodes.join(settled, "node", "left").select(F.col("node").alias(child), "level")
