"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The hashes of a text's word shingles are dealt into ``BINS`` bins by their top bits and each bin keeps its least hash:
one hash per shingle. An empty bin borrows from a filled bin by optimal densification: each bin has its own random order
of all bins, the same in every document, and takes the first filled one. A bin's hash is mixed with the bin's number
(else a short text, whose bins all borrow the same few hashes, would agree with another in all of them by one chance)
and its low ``BITS`` bits are stored, packed as hex. The likeness of two fingerprints is the share of equal bins, corrected for bins that agree by chance
(2 ** -BITS), between 0 and 1.

Defined cases: words are separated by spaces and tab to carriage return, after lower-casing; fewer words than ``words``
make one shingle; null text counts as empty text, and a text without words has the fingerprint of no shingles (zeros,
prefixed by a flag), alike to itself only; equal texts have equal fingerprints; ids may be integers of any spread or strings (compared byte by byte); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORDS = 5
BINS = 128
BITS = 8
_SHIFT = 57  # 64 - log2(BINS)
#: Documents that one window holds about, and the most windows.
BUCKET_DOCS = 1_000
MAX_BUCKETS = 100_000
PARTS = 256


def with_fingerprint(rows: DataFrame, text_col: str, out: str, words: int = WORDS) -> DataFrame:
    """``rows`` with the array ``out``: the low bits of each bin, or an empty array for a text without words."""
    gaps = F.filter(F.split(F.lower(text_col), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    rows = rows.withColumn("_w", gaps)
    w = F.col("_w")
    shingle = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (words - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get(F.col("_w"), i + k) for k in range(1, words))),
    )
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_h", F.sort_array(F.when(F.size(w) >= words, shingle).otherwise(whole))).drop("_w")

    def bin_of(h: Column) -> Column:
        return F.shiftrightunsigned(h, _SHIFT)

    least = F.filter("_h", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col("_h"), i - 1))))
    rows = rows.withColumn("_m", least).drop("_h")
    rows = rows.withColumn("_b", F.transform("_m", bin_of))

    def low(at: Column, j: Column) -> Column:
        return F.xxhash64(F.get(F.col("_m"), at), j).bitwiseAND((1 << BITS) - 1)

    def borrowed(j: Column) -> Column:
        order = F.transform("_b", lambda b, i: F.struct(F.xxhash64(j, b).alias("p"), i.alias("i")))
        return low(F.array_min(order)["i"], j)

    def value(j: Column) -> Column:
        at = F.array_position("_b", j).cast("int")
        return F.when(at > 0, low(at - 1, j)).otherwise(borrowed(j)).cast("int")

    bins = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")), value)
    return rows.withColumn(out, F.when(F.size("_m") > 0, bins).otherwise(F.array().cast("array<int>"))).drop("_m", "_b")


def packed(bins: Column) -> Column:
    """The fingerprint as hex: a flag (1: has shingles), then BITS bits for each bin."""
    digits = BITS // 4
    body = F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")
    return F.when(F.size(bins) > 0, F.concat(F.lit("1"), body)).otherwise(F.lit("0" * (1 + BINS * digits)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints (arrays of bins), corrected for chance agreement."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    chance = 2.0**-BITS
    estimate = F.greatest((same / F.lit(BINS) - chance) / (1 - chance), F.lit(0.0))
    none = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), estimate).otherwise(none).cast("double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: id, fingerprint."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = with_fingerprint(rows, "_text", "_f", words)
    return rows.select(F.col("_id").alias(id_col), packed(F.col("_f")).alias("fingerprint"))


def in_ranges(rows: DataFrame, id_col: str, tie: Column) -> DataFrame:
    """``rows`` with _bucket (a range of ids: ``PARTS`` parts of about equal numbers
    of rows, each cut into equal widths, so that outlying ids put no more than one part into one range), _tie, and _copy (0); and once more, with _copy 1, the first row of
    each range in descending order, dealt to the range before it, so that a window of one range sees the row after its
    last. The last range gets the first row of all. There are at most ``MAX_BUCKETS`` ranges.
    """
    text_ids = isinstance(rows.schema[id_col].dataType, StringType)
    # a number in the order of the ids: of a string, its first six bytes
    x = F.conv(F.rpad(F.hex(F.substring(F.encode(id_col, "UTF-8"), 1, 6)), 12, "0"), 16, 10) if text_ids else F.col(id_col)
    x = x.cast("double")
    shares = [i / PARTS for i in range(PARTS + 1)]
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(x, shares, 100 * PARTS).alias("cuts")).first()
    cuts = sorted(set(size.cuts or [0.0]))
    each = -(-min(MAX_BUCKETS, (size.n or 0) // BUCKET_DOCS + 1) // len(cuts))
    part = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("_x")))
    low, high = F.get(F.lit(cuts), F.col("_part") - 1), F.get(F.lit(cuts), F.col("_part"))
    inside = F.least(F.lit(each - 1), F.floor((F.col("_x") - low) / (high - low) * each))
    bucket = F.when(F.col("_x").isNull(), -1).otherwise(F.col("_part") * each + F.coalesce(inside, F.lit(0))).cast("long")
    rows = rows.withColumn("_x", x).withColumn("_part", part)
    rows = rows.withColumn("_bucket", bucket).drop("_x", "_part")
    rows = rows.withColumn("_tie", tie)
    firsts = rows.groupBy("_bucket").agg(F.max(F.struct(F.col(id_col).alias("i"), F.col("_tie").alias("t"))).alias("_first"))
    order = Window.orderBy(F.desc("_bucket"))  # one row a range, MAX_BUCKETS + 1 at most
    above = F.lag("_bucket").over(order)
    last = F.min("_bucket").over(Window.partitionBy())
    ends = firsts.select("_first", F.coalesce(above, last).alias("_to"))
    ends = F.broadcast(ends.select(F.col("_first.i").alias("_i"), F.col("_first.t").alias("_t"), "_to"))
    copies = rows.join(ends, F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t"))).select(
        *[c for c in rows.columns if c != "_bucket"], F.col("_to").alias("_bucket"), F.lit(1).alias("_copy")
    ).dropDuplicates(["_bucket", id_col, "_tie"])
    return rows.withColumn("_copy", F.lit(0)).unionByName(copies)


def with_next(dealt: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """From rows of :func:`in_ranges`, the rows themselves with next_<column>: the values of the row with the next
    smaller id, and after the last row those of the first. Equal ids follow each other by _tie."""
    along = Window.partitionBy("_bucket").orderBy("_copy", F.col(id_col).desc_nulls_last(), F.desc("_tie"))
    out = dealt.select(*dealt.columns, *[F.lead(c).over(along).alias(f"next_{c}") for c in columns])
    return out.filter("_copy = 0").drop("_copy", "_bucket", "_tie")


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half replaced by as much of the next document (descending ids) from its
    start.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = with_fingerprint(in_ranges(rows, "_id", F.xxhash64("_text")), "_text", "_f", words)
    rows = with_next(rows, "_id", ["_text", "_f"])
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring("next__text", F.lit(1), half))
    rows = rows.select("_id", n.cast("long").alias("_n"), "_f", F.col("next__f").alias("_g"), edited.alias("_edited"))
    rows = with_fingerprint(rows.withColumn("_sha", F.sha2("_edited", 256)), "_edited", "_e", words)
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_chars"),
        F.col("_sha").alias("edited_sha256"),
        packed(F.col("_f")).alias("fingerprint"),
        packed(F.col("_e")).alias("edited_fingerprint"),
        likeness(F.col("_f"), F.col("_e")).alias("near_edited"),
        likeness(F.col("_f"), F.col("_g")).alias("near_next"),
    )
