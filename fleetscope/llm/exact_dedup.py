"""Exact duplicates by two-pass Bloom filtering.

Pass 1 adds the hash of every text to a Bloom filter that marks cells hit twice (:mod:`.bloom`). Pass 2 asks the filter
about each text: if one of its cells was hit once only, no other row has this text, and the row passes straight through
as its own group. Only the other rows (true repeats and a few false alarms) are shuffled, by SHA-256, without their
texts. The filter's size is bounded; beyond the bound more rows are false alarms and take the shuffle, so the result is
the same at every size.

Defined cases: null text counts as empty text, and all empty texts are equal; rows with a null id form groups like
any other and lose every tie; repeated rows (same id and text) count one by one and only their id is kept, so each
of them is marked kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Filter
from .skew import attach
from .store import written


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: Column | None = None) -> DataFrame:
    """Per row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    ``text`` may give a normalised form of the text column to compare instead of the text as it is.
    """
    body = F.coalesce(text if text is not None else F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), body.alias("_text"))
    total = rows.count()
    twice = Filter(rows.select(F.xxhash64("_text").alias("_h")), total, least=2)
    asked = written(
        rows.select("_id", F.sha2("_text", 256).alias("_sha"), F.xxhash64("_text").alias("_h"))
        .withColumn("_maybe", twice.asked("_h")).drop("_h"),
        "asked",
    )
    twice.close()
    alone = asked.filter(~F.col("_maybe")).select("_id", "_sha", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"))
    again = asked.filter("_maybe").drop("_maybe")
    groups = again.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    found = attach(again, groups, ["_sha"], "_n", total).select("_id", "_sha", "_keep", "_n")
    return alone.unionByName(found).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts, the row with the largest id."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
