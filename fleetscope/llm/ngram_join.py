"""Jaccard similarity join of documents on word shingles by PartEnum signatures, and the components of its links.

Signatures. Sizes fall into bands [l, floor(l / s)], so that two sets of similarity s lie in one band or in neighbours;
each set signs for its own band and for the next. In a band with largest size r two similar sets differ in at most
k = 2 r (1 - s) / (1 + s) elements. The hash domain is cut into parts of N2 = 2 partitions each, SLACK times k + 1
partitions in all, and a signature is the part of the set that lies in one partition (a subset of N2 - 1 partitions of its
part). Similar sets differ in k partitions at most and share all others. A set leaves out its emptiest partitions, as long
as it leaves out fewer than similar sets must share: of the shared ones, one then holds more than either set leaves out,
so both sign with it and no link is lost, while unrelated sets rarely agree (two empty partitions would).

Candidates. Equal sets are one class (128-bit hash and size), which only its smallest id represents. Signatures are
sorted by value; members of a bucket are read in runs, so a bucket is never held in memory. No bucket is expanded into
all its pairs: first each member is paired with the first and the previous member of its bucket, pairs are checked on
whole sets and the links joined to components; then, only in buckets whose members still lie in different components,
members of different components are compared. Parity sketches (two sets differ in at least as many elements as their
sketches in bits) drop pairs that cannot link before sets are fetched, one of 512 bits inside the buckets and a wide one
(four bits an element, 2,048 at least) for the pairs that remain; they drop no link. Large buckets are compared in blocks of ``BLOCK``
members.

Defined cases: null, empty and word-free texts have the empty set and link with nothing; fewer words than ``words`` make
one shingle; rows with equal ids are one node (any of their texts links it); a null id gets a null component; repeated
rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import Filter, marked
from .components import components
from .shingles import batches_of_sets, mix
from .skew import attach, few
from .store import dropped, written

WORDS = 5
SIMILARITY = (4, 5)
N2 = 2
SLACK = 1.25
SKETCH_WORDS = 8
WIDE_WORDS = 32
#: Members of a bucket compared with each other in one task.
BLOCK = 20_000
#: Pairs of sketches, and of whole sets, that one task compares.
TASK_PAIRS, TASK_SETS = 50_000, 5_000
#: Pairs checked for each document in the first pass, the closest by sketch; the others wait for the second pass.
FIRST_CHECKS = 3

_GOLD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(None)
def bands(similarity: tuple[int, int], upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The last size of each band, and the most elements in which similar sets of the band differ."""
    num, den = similarity
    last, most, r = [], [], 0
    while not last or last[-2 if len(last) > 1 else -1] < upto:
        r = (r + 1) * den // num
        last.append(r)
        most.append(2 * r * (den - num) // (den + num))
    return np.array(last), np.array(most)


def signatures(elements: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The signatures of a set of distinct 64-bit hashes (uint64)."""
    n = len(elements)
    if not n:
        return np.empty(0, np.uint64)
    last, most = bands(similarity, 1 << max(10, n.bit_length() + 1))
    own = int(np.searchsorted(last, n))
    out = []
    with np.errstate(over="ignore"):
        value = mix(elements * _GOLD)
        place = elements >> np.uint64(20)
        for band in (own, own + 1):
            k = int(most[band])
            if not k:  # similar sets of these sizes are equal
                continue
            parts = -(-int(SLACK * (k + 1) + 0.999) // N2) * N2
            at = (place % np.uint64(parts)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            edge = np.searchsorted(at[order], np.arange(parts + 1))
            sums = np.r_[np.uint64(0), np.cumsum(value[order])]
            size = np.diff(edge)
            each = sums[edge[1:]] - sums[edge[:-1]] + size.astype(np.uint64) * _GOLD
            upto = np.cumsum(np.bincount(size))  # partitions with so many elements or fewer
            few = int(np.searchsorted(upto, parts - k)) - 1  # the most that fewer than parts - k partitions have
            each = mix(each + mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)))
            out.append(each[size > few])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _class_hash(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        both = np.array([mix(s * _GOLD).sum(dtype=np.uint64), mix(s + _GOLD).sum(dtype=np.uint64)])
        return tuple(_signed(mix(both + np.uint64(len(s)))).tolist())


def _shapes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2 = [], [], []
            for _, s in batches_of_sets(b, words):
                x, y = _class_hash(s) if len(s) else (0, 0)
                n.append(len(s))
                h1.append(x)
                h2.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (n, h1, h2))], names=["id", "n", "h1", "h2"])

    return run


def _signed_rows(words: int, similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, sig, node, held = set(), [], [], 0
            for _, s in batches_of_sets(b, words):
                if not len(s):
                    continue
                h = _class_hash(s)
                if h in seen:  # a copy in this batch has the same rows
                    continue
                seen.add(h)
                x = signatures(s, similarity)
                sig.append(x)
                node.append(np.full(len(x), h[0], np.int64))
                held += len(x)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sig))), pa.array(np.concatenate(node))], names=["sig", "node"])
                    sig, node, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sig))), pa.array(np.concatenate(node))], names=["sig", "node"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, node): the members of buckets with two different nodes or more, each with the first
    and the previous node of its bucket. Holds a batch and the last row before it."""
    last: tuple[int, int, int, int] | None = None  # sig, first node, last node, members so far
    for b in batches:
        if not b.num_rows:
            continue
        sig, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        if last:
            sig, node = np.r_[last[0], sig], np.r_[last[2], node]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node = sig[fresh], node[fresh]
        begin = np.r_[True, sig[1:] != sig[:-1]]
        at = np.maximum.accumulate(np.where(begin, np.arange(len(sig)), 0))
        first, nth = node[at], np.arange(len(sig)) - at
        if last:
            run = at == 0
            first = np.where(run, last[1], first)
            nth = np.where(run, nth + last[3] - 1, nth)
        prev = np.r_[node[0], node[:-1]]
        new = np.arange(len(sig)) >= (1 if last else 0)
        more = new & (nth > 0)
        second = new & (nth == 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[sig[more], sig[second]]),
                pa.array(np.r_[node[more], first[second]]),
                pa.array(np.r_[first[more], first[second]]),
                pa.array(np.r_[prev[more], first[second]]),
            ],
            names=["sig", "node", "first", "prev"],
        )
        last = (int(sig[-1]), int(first[-1]), int(node[-1]), int(nth[-1]) + 1)


def wide_words(n: int) -> int:
    """Longs of the wide sketch of a set of ``n``: a power of two, four bits an element at least, or a sketch of a long
    text would say nothing."""
    return max(WIDE_WORDS, 1 << (max(1, n) - 1 >> 4).bit_length())


def _folded(x: Column, y: Column) -> Column:
    """``x`` at half its width (parities on half as many places) where it is wider than ``y``."""
    half = F.floor(F.size(x) / 2).cast("int")
    return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(x)


def _parities(s: np.ndarray, longs: int) -> np.ndarray:
    """Whether an odd number of elements fall on each of 64 * ``longs`` places, as bits."""
    odd = np.bincount((s & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _features(words: int, wanted):
    """Sets and sketches of the rows (id, text, hash of the id) whose hash the broadcast filter ``wanted`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            b = whole.filter(pa.array(marked(wanted.value, whole.column(2).to_numpy(zero_copy_only=False))))
            rows, lists, held = [], [], 0
            for i, s in batches_of_sets(b, words):
                if not len(s):
                    continue
                if held > 500_000:
                    yield out(b, rows, lists)
                    rows, lists, held = [], [], 0
                held += len(s)
                rows.append(i)
                lists.append((len(s), _parities(s, SKETCH_WORDS), _parities(s, wide_words(len(s))), _signed(s)))
            yield out(b, rows, lists)

    def out(b, rows, lists) -> pa.RecordBatch:
        n, *arrays = zip(*lists, strict=True) if lists else ((), (), (), ())
        columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in arrays)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n", "sketch", "wide", "elements"])

    return run


def _may_link(sa: Column, sb: Column, na: Column, nb: Column, similarity: tuple[int, int]) -> tuple[Column, Column]:
    num, den = similarity
    apart = F.aggregate(F.zip_with(sa, sb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return apart, (apart * (den + num) <= (na + nb) * (den - num)) & (F.least(na, nb) * den >= F.greatest(na, nb) * num)


def _across(similarity: tuple[int, int]):
    num, den = similarity

    def compare(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        node, n, label, block, low, high, sketch = rows
        names, kind = np.unique(label, return_inverse=True)
        if len(names) < 2:
            return node[:0], node[:0]
        left = np.flatnonzero(kind != np.bincount(kind).argmax())  # two labels differ only if one isn't the largest
        a, b = [], []
        sketch = sketch.view(np.uint64)
        for lo in range(0, len(left), 128):
            i = left[lo : lo + 128]
            apart = np.zeros((len(i), len(node)), np.int32)
            for w in range(SKETCH_WORDS):
                apart += np.bitwise_count(sketch[i, w][:, None] ^ sketch[None, :, w])
            near = apart * (den + num) <= (n[i][:, None] + n[None, :]) * (den - num)
            near &= np.minimum(n[i][:, None], n[None, :]) * den >= np.maximum(n[i][:, None], n[None, :]) * num
            near &= label[i][:, None] != label[None, :]
            if low[0] != high[0]:
                near &= block[i][:, None] != block[None, :]
            x, y = np.nonzero(near)
            a.append(node[i[x]])
            b.append(node[y])
        a, b = np.concatenate(a), np.concatenate(b)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (sig, low, high); holds one block pair of a bucket."""
        held: list[tuple] = []
        key = None

        def done() -> pa.RecordBatch:
            cols = [np.array(c) for c in zip(*held, strict=True)]
            a, b = compare(cols)
            pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for sig, low, high, block, node, n, label, sketch in zip(*cols, strict=True):
                if key != (sig, low, high):
                    if len(held) > 1:
                        yield done()
                    held, key = [], (sig, low, high)
                held.append((node, n, label, block, low, high, sketch))
        if len(held) > 1:
            yield done()

    return run


def _links(pairs: DataFrame, features: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b; a written table) whose whole sets are similar; a wide sketch drops most others before the sets move."""
    rows = pairs.count()
    num, den = similarity
    one = features.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("wide").alias("_wa"))
    two = features.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("wide").alias("_wb"))
    # sizes that can link are within one power of two
    wide = _folded(F.col("_wa"), F.col("_wb")), _folded(F.col("_wb"), F.col("_wa"))
    _, may = _may_link(*wide, F.col("_na"), F.col("_nb"), similarity)
    close = few(few(pairs.select("a", "b").join(one, "a"), rows, TASK_SETS).join(two, "b").filter(may).select("a", "b"), rows, TASK_SETS)
    one = features.select(F.col("id").alias("a"), F.col("elements").alias("_x"))
    two = features.select(F.col("id").alias("b"), F.col("elements").alias("_y"))
    both = few(few(close.join(one, "a"), rows, TASK_SETS).join(two, "b"), rows, TASK_SETS)
    common = F.size(F.array_intersect("_x", "_y")).cast("long")
    total = F.size("_x") + F.size("_y")
    return both.withColumn("_c", common).filter(F.col("_c") * den >= (total - F.col("_c")) * num).select("a", "b")


def _same_ids(whole: DataFrame, classes: DataFrame, keys: list[str], total: int) -> DataFrame | None:
    """Links between the classes of each id that has texts of several classes; None if no id has."""
    kinds = whole.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), *[f(k).alias(f"_{f.__name__}_{k}") for k in keys for f in (F.min, F.max)])
    mixed = " OR ".join(f"_min_{k} != _max_{k}" for k in keys)
    several = written(few(kinds.filter(mixed).select("id", "_n"), total), "several")
    if not several.count():
        return None
    some = attach(whole, several, ["id"], "_n", total).filter("_n IS NOT NULL").drop("_n")
    reps = written(attach(some, classes, keys, "copies", total).select("id", "rep").distinct(), "reps")
    least = reps.groupBy("id").agg(F.min("rep").alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    same = attach(reps, least, ["id"], "_n", total).filter(F.col("rep") != F.col("_least"))
    same = written(same.select(F.col("rep").alias("a"), F.col("_least").alias("b")).distinct(), "same-ids")
    dropped(reps)
    return same


def _tied(labelled: DataFrame, label: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """``labelled`` (class representatives with their component) after more ``links`` (a, b): only these are joined to components
    again, as links between components."""
    rows = links.count()
    ends = links.join(label.select(F.col("node").alias("a"), F.col("label").alias("_la")), "a", "left")
    ends = few(ends, rows).join(label.select(F.col("node").alias("b"), F.col("label").alias("_lb")), "b", "left")
    ends = ends.select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b")).filter("a != b")
    between = written(few(ends, rows), "links-between")
    if not between.count():
        return labelled
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    top = components(between).select(F.col("node").alias("component"), F.col("label").alias("_top"))
    groups = written(few(sizes.join(top, "component", "left"), total), "components")
    out = attach(labelled, groups, ["component"], "_n", total)
    return out.withColumn("component", F.coalesce("_top", "component")).select(*labelled.columns)


def linked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """Per row: id, n_shingles, class_id (smallest id with the same set) and component_id (smallest id reachable by links).

    Two documents link when the Jaccard similarity of their shingle sets is at least similarity[0] / similarity[1].
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shapes = written(rows.mapInArrow(_shapes(words), "id long, n long, h1 long, h2 long"), "shapes")
    whole = shapes.filter((F.col("n") > 0) & F.col("id").isNotNull())
    keys = ["h1", "h2", "n"]
    total = whole.count()
    classes = written(few(whole.groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), total), "classes")
    same = _same_ids(whole, classes, keys, total)

    signed = rows.filter(F.col("id").isNotNull()).mapInArrow(_signed_rows(words, similarity), "sig long, node long")
    ordered = signed.repartition("sig").sortWithinPartitions("sig", "node")
    members = written(ordered.mapInArrow(_members, "sig long, node long, first long, prev long"), "members")
    n_pairs = 2 * members.count()
    near = members.select(F.col("node").alias("x"), F.col("first").alias("y")).unionByName(members.select(F.col("node").alias("x"), F.col("prev").alias("y")))
    ids = classes.select(F.col("h1").alias("x"), F.col("rep").alias("a"))
    others = classes.select(F.col("h1").alias("y"), F.col("rep").alias("b"))
    pairs = few(few(near.filter("x != y").distinct(), n_pairs, TASK_PAIRS).join(ids, "x"), n_pairs, TASK_PAIRS).join(others, "y")
    pairs = few(pairs.select("a", "b").filter("a != b"), n_pairs, TASK_PAIRS)
    wanted = few(members.select("node").distinct(), total).join(classes.select(F.col("h1").alias("node"), "rep"), "node").select("rep")
    wanted = written(few(wanted, total), "wanted")
    some = Filter(wanted.select(F.xxhash64("rep").alias("h")), wanted.count(), least=1)
    hashed = rows.withColumn("h", F.xxhash64("id"))
    features = written(
        hashed.mapInArrow(_features(words, some.sent), "id long, n long, sketch array<long>, wide array<long>, elements array<long>"), "features"
    )
    some.close()
    small = features.select("id", "n", "sketch")

    one = small.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = small.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    apart, may = _may_link(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), similarity)
    close = few(pairs.join(one, "a"), n_pairs, TASK_PAIRS).join(two, "b").filter(may).select("a", "b", apart.alias("apart"))
    close = few(close, n_pairs, TASK_PAIRS)
    closest = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    checked = written(few(close.withColumn("_k", closest).filter(F.col("_k") <= FIRST_CHECKS).select("a", "b"), n_pairs, TASK_PAIRS), "checked")
    first_links = _links(checked, features, similarity)
    if same is not None:
        first_links = first_links.unionByName(same)
    label = written(components(written(first_links, "first-links")), "labels")

    node = F.coalesce(F.col("label"), F.col("rep"))
    placed = few(members.select("sig", F.col("node").alias("h1")).join(classes.select("h1", "rep"), "h1"), n_pairs, TASK_PAIRS)
    placed = few(placed.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", node.alias("label")), n_pairs, TASK_PAIRS)
    open_buckets = (
        placed.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo != hi")
        .select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    mixed = (
        placed.join(open_buckets, "sig").join(small.withColumnRenamed("id", "rep"), "rep").withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "n", "label", "sketch")
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but many comparisons: not coalesced
    across = mixed.repartition(tasks, "sig", "low", "high").sortWithinPartitions("sig", "low", "high").mapInArrow(_across(similarity), "a long, b long")
    across = written(across.distinct(), "across")
    labelled = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(*keys, "copies", "rep", node.alias("component"))
    if across.count():
        more_links = written(_links(across, features, similarity), "links")
        labelled = _tied(labelled, label, more_links, total)
    dropped(features)
    dropped(members)

    found = attach(whole, labelled, keys, "copies", total).select("id", "n", "rep", "component")
    alone = shapes.filter((F.col("n") == 0) | F.col("id").isNull()).select("id", "n", F.col("id").alias("rep"), F.col("id").alias("component"))
    return found.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.col("component").alias("component_id")
    )


def _node(id_col: str, text_col: str) -> Column:
    """The id of a row; for a row without one, a number from its text (62 bits), null if that has no words."""
    body = F.col(text_col).cast("string")
    made = F.xxhash64(body).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    return F.coalesce(F.col(id_col).cast("long"), F.when(body.rlike("[^\\x20\\x09-\\x0D]"), made))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One document of each component stays (the smallest id; a row without an id only where no other has one), with all
    its columns. Of rows with equal ids, or equal texts and no id, one stays: that with the least hash of all columns.
    Rows with neither an id nor words all stay."""
    keyed = docs.withColumn("_node", _node(id_col, text_col))
    found = linked(keyed.select("_node", F.col(text_col).alias("_text")), "_node", "_text", words, similarity)
    gone = written(found.filter(F.col("component_id") != F.col("_node")).select(F.col("_node").alias("_gone")).distinct(), "gone")
    left = keyed.join(gone, F.col("_node") == F.col("_gone"), "left_anti")
    again = written(keyed.groupBy("_node").count().filter("_node IS NOT NULL AND count > 1").select(F.col("_node").alias("_again")), "repeated-ids")
    if not again.count():
        return left.drop("_node")
    single = left.join(again, F.col("_node") == F.col("_again"), "left_anti")
    order = F.struct(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns]), F.col(text_col))
    several = left.join(again, F.col("_node") == F.col("_again"), "left_semi")
    one = several.groupBy("_node").agg(F.min_by(F.struct(*[docs[f"`{c}`"] for c in docs.columns]), order).alias("_row"))
    return single.drop("_node").unionByName(one.select("_row.*"))
