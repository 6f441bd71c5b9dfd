"""Cross-site boilerplate lines, removed by the number of distinct sites they stand on.

Every line gets a 128-bit key. One aggregation by key merges HyperLogLog sketches of the sites, the count and the first
place of the line. Lines whose estimate lies within three standard errors of the threshold are counted exactly; the
others are decided by the estimate. A line on at least ``min_sites`` sites is boilerplate: it stays at its first place
(smallest id, then position) and goes everywhere else, so no text is lost altogether. DataFrame functions only.

A line that a third of all lines repeat is one sketch per map task before the shuffle, and the join of lines to the
boilerplate table broadcasts only keys that hold a thousandth of all lines each (1000 at most).

Defined cases: null text stays null and has no lines; lines are compared without leading and trailing spaces, and
blank lines are never removed; a null site counts as the empty site; a null id is an id of its own that sorts first;
rows with equal ids count as separate places of the same document; repeated rows are all treated alike; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import attach
from .store import written

MIN_SITES = 10
LOG_REGISTERS = 10


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line), F.xxhash64(F.lit("second"), line)]


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """From lines (_k1, _k2, _id, _pos, _site): _k1, _k2, _first (id, pos), _n of the lines on enough sites."""
    keys = ["_k1", "_k2"]
    merged = written(
        lines.groupBy(*keys)
        .agg(
            F.hll_sketch_agg("_site", F.lit(LOG_REGISTERS)).alias("_sketch"),
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct("_id", "_pos")).alias("_first"),
        )
        .withColumn("_sites", F.hll_sketch_estimate("_sketch"))
        .filter(F.col("_n") >= min_sites)
        .drop("_sketch"),
        "line-sites",
    )
    band = max(1, math.ceil(3 * 1.04 / math.sqrt(1 << LOG_REGISTERS) * min_sites))
    sure = merged.filter(F.col("_sites") > min_sites + band)
    near = merged.filter(F.col("_sites").between(min_sites - band, min_sites + band))
    exact = (
        attach(lines, near.select(*keys, "_n"), keys, "_n", lines.count()).filter("_n IS NOT NULL").groupBy(*keys, "_site").agg(F.lit(1).alias("_one"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_exact")).filter(F.col("_exact") >= min_sites)
    )
    near = near.join(exact.select(*keys), keys, "left_semi")
    return sure.unionByName(near).select(*keys, "_first", "_n")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES,
) -> DataFrame:
    """All rows and columns of ``docs``, the text without boilerplate lines, and n_lines and n_removed (in place of
    columns of these names)."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit(""))
    body = docs.select(F.col(id_col).alias("_id"), site.alias("_site"), F.posexplode(F.split(text_col, "\n", -1)).alias("_pos", "_line"))
    k1, k2 = _key(F.trim("_line"))
    lines = written(
        body.filter(F.trim("_line") != "").select("_id", "_pos", "_site", k1.alias("_k1"), k2.alias("_k2")), "lines"
    )
    total = lines.count()
    common = written(boilerplate(lines, min_sites), "boilerplate")
    hits = attach(lines.select("_id", "_pos", "_k1", "_k2"), common, ["_k1", "_k2"], "_n", total).filter(
        F.col("_n").isNotNull() & ~(F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_pos") == F.col("_first._pos")))
    )
    place = lambda pos, k: F.concat_ws(":", pos, k)
    gone = hits.groupBy("_id").agg(F.collect_set(place(F.col("_pos"), F.col("_k1"))).alias("_gone"))
    gone = gone.withColumnRenamed("_id", "_gone_id")
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]), "left")
    # places as strings, so that the planner's set difference hashes them; the generator keeps the split from being repeated
    own = [docs[f"`{c}`"] for c in docs.columns]
    joined = joined.select(F.struct(*own).alias("_row"), "_gone", F.explode(F.array(F.struct(F.split(docs[text_col], "\n", -1).alias("parts")))).alias("_t"))
    joined = joined.select("_row", "_gone", F.col("_t.parts").alias("_parts"))
    places = F.transform("_parts", lambda line, i: place(i, F.xxhash64(F.trim(line))))
    joined = joined.withColumn("_left", F.when(F.col("_gone").isNotNull(), F.array_except(places, F.col("_gone"))))
    left = F.transform("_left", lambda x: F.get(F.col("_parts"), F.substring_index(x, ":", 1).cast("int")))
    text = F.col("_row")[text_col]
    touched = F.col("_gone").isNotNull() & text.isNotNull()
    return joined.select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_removed")],
        F.when(touched, F.array_join(left, "\n")).otherwise(text).alias(text_col),
        F.when(text.isNull(), 0).otherwise(F.size("_parts")).cast("long").alias("n_lines"),
        F.when(touched, F.size("_parts") - F.size("_left")).otherwise(0).cast("long").alias("n_removed"),
    )
