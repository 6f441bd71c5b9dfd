"""Exact dedup, n-gram join and line dedup against brute force, and their defined cases."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm import exact_dedup, line_dedup, ngram_join, shingles
from fleetscope.llm.bloom import Filter
from pyspark.sql import functions as F


def test_exact_groups_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, exact_dedup.exact_groups(odd_docs).collect()), key=str)
    texts = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    want = []
    for i, t in texts:
        same = [j for j, u in texts if u == t and j is not None]
        keep = max(same, default=None)
        want.append((i, keep, sum(u == t for _, u in texts), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_groups(no_docs).count() == 0
    kept = exact_dedup.exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "5", "6", "7", "None"]


def test_exact_groups_hot_group(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == 5000
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id % 3 == 0} == {(4998, 1667)}
    assert all(r.kept and r.group_size == 1 for r in rows if r.doc_id % 3)


def test_bloom_has_no_wrong_denial(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    ask = Filter(rows, 20_000, least=1).asked
    assert rows.filter(ask("h")).count() == 20_000
    false = spark.range(100_000, 120_000).select(F.xxhash64("id").alias("h")).filter(ask("h")).count()
    assert false < 400
    twice = Filter(rows.union(rows.limit(100)), 20_100, least=2).asked
    assert 100 <= rows.filter(twice("h")).count() < 1500


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingle_set(text, n):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(docs, n, num, den):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingle_set(t, n))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and len(x & y) * den >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def walk_docs(seed, groups=6, size=25, words=60):
    """Groups of texts that drift apart edit by edit, so that links form chains."""
    rnd, docs = random.Random(seed), []
    for _ in range(groups):
        text = [rnd.choice("abcdefghij") + str(rnd.randrange(400)) for _ in range(rnd.choice([12, 30, words, 4 * words]))]
        for _ in range(size):
            docs.append(" ".join(text))
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                text[rnd.randrange(len(text))] = str(rnd.randrange(10**6))
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("n,similarity", [(3, (9, 10)), (5, (4, 5))])
def test_join_against_brute_force(spark, n, similarity):
    docs = walk_docs(n)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.linked(df, words=n, similarity=similarity).collect()
    want = brute_components(docs, n, *similarity)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t, n)) for i, t in docs}
    assert 1 < len(set(want.values())) < len(docs) - 20


def test_join_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, ngram_join.linked(odd_docs, words=3, similarity=(9, 10)).collect()), key=str)
    assert got == sorted(
        [(1, 7, 1, 1), (2, 0, 2, 2), (3, 0, 3, 3), (4, 7, 1, 1), (5, 1, 5, 5), (5, 1, 5, 5), (6, 0, 6, 6), (None, 1, None, None), (7, 1, 7, 7)], key=str
    )
    assert ngram_join.linked(no_docs).count() == 0
    kept = ngram_join.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "None"]


def test_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    docs = walk_docs(11, groups=2, size=40)
    got = ngram_join.linked(spark.createDataFrame(docs, "doc_id long, text string"), words=3, similarity=(9, 10)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(docs, 3, 9, 10)


def test_long_texts_with_sketches_of_two_widths(spark):
    rnd, docs = random.Random(8), []
    for _ in range(4):
        text = [str(rnd.randrange(10**6)) for _ in range(1010)]
        for _ in range(14):
            docs.append(" ".join(text))
            at = rnd.randrange(len(text) - 60)
            text[at : at + 20] = [str(rnd.randrange(10**6)) for _ in range(rnd.choice([5, 20, 45]))]
    docs = list(enumerate(docs))
    sizes = {ngram_join.wide_words(len(shingle_set(t, 5))) for _, t in docs}
    assert sizes == {64, 128}
    got = ngram_join.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_components(docs, 5, 4, 5)
    assert {r.doc_id: r.component_id for r in got} == want and 1 < len(set(want.values())) < len(docs)


def test_wide_sketch_folds():
    rnd = np.random.default_rng(2)
    s = rnd.integers(0, 2**64, 700, dtype=np.uint64)
    wide, narrow = ngram_join._parities(s, 64), ngram_join._parities(s, 32)
    assert (wide[:32] ^ wide[32:] == narrow).all()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 300), st.integers(0, 60), st.integers(0, 60), st.sampled_from([(9, 10), (4, 5), (3, 5)]), st.integers(0, 2**32))
def test_similar_sets_share_a_signature(common, only_a, only_b, similarity, seed):
    num, den = similarity
    if common * den < num * (common + only_a + only_b) or not only_a + only_b:
        return
    rnd = np.random.default_rng(seed)
    x = rnd.integers(0, 2**64, common + only_a + only_b, dtype=np.uint64)
    a, b = np.sort(x[: common + only_a]), np.sort(np.r_[x[:common], x[common + only_a :]])
    assert set(ngram_join.signatures(a, similarity).tolist()) & set(ngram_join.signatures(b, similarity).tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\t\n\x0b x", max_size=40), max_size=8), st.integers(1, 5))
def test_shingles_match_words(texts, n):
    import pyarrow as pa

    sets = list(shingles.shingle_sets(pa.array(texts, pa.large_string()), n))
    assert [len(s) for s in sets] == [len(shingle_set(t, n)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingle_set(a, n) & shingle_set(b, n))


def test_long_text_is_cut_at_separators():
    import pyarrow as pa

    text = "alpha beta " * 250_000 + "x" * 3_000_000 + " end"
    a, b = shingles.shingle_sets(pa.array([text, "alpha beta alpha beta"], pa.large_string()), 2)
    assert len(a) == 4 and len(np.intersect1d(a, b)) == 2


def brute_lines(rows, least):
    places = {}
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" "):
                places.setdefault(line.strip(" "), []).append(((i, p), s or ""))
    common = {k: min(x for x, _ in v) for k, v in places.items() if len({s for _, s in v}) >= least}
    out = {}
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        left = [x for p, x in enumerate(lines) if x.strip(" ") not in common or common[x.strip(" ")] == (i, p)]
        out[i] = ("\n".join(left) if t is not None else None, len(lines), len(lines) - len(left))
    return out


@pytest.mark.parametrize("least", [2, 9, 10, 40])
def test_line_dedup_against_brute_force(spark, least):
    rnd = random.Random(least)
    pool = [f"line {k}" for k in range(60)]
    rows = [(i, "\n".join(rnd.choice(pool[: 1 + rnd.randrange(60)]) + rnd.choice(["", " "]) for _ in range(rnd.randrange(9))), f"s{rnd.randrange(50)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(df, min_sites=least).collect()}
    want = brute_lines(rows, least)
    assert got == want and any(v[2] for v in want.values())


def test_line_dedup_odd_rows(odd_docs, no_docs):
    out = line_dedup.line_dedup(odd_docs, min_sites=2)
    assert sorted(out.columns) == sorted([*odd_docs.columns, "n_removed"])
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert (4, "", 1, 1) in got and (2, None, 0, 0) in got and (3, "", 1, 0) in got and (6, "  \n \t ", 2, 0) in got
    assert out.count() == odd_docs.count()
    assert line_dedup.line_dedup(no_docs).count() == 0


def test_line_dedup_plan_is_native(spark, sf_small):
    from fleetscope.llm.queries import QUERIES

    for name in ("op10_line_dedup", "op9_document_fingerprints"):
        plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_ids_with_several_texts_are_one_node(spark):
    x, y, z = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey"
    rows = [(1, x), (5, x), (5, y), (2, y), (2, None), (7, z), (8, z), (9, x), (9, x), (None, z), (None, y)]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), words=3, similarity=(9, 10)).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles} == {(1, 1), (5, 1), (2, 1), (7, 7), (8, 7), (9, 1), (None, None)}
    # over a chain of ids that represent none of their classes
    texts = [f"chain {k} " + " ".join(f"w{k}x{j}" for j in range(8)) for k in range(6)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k in range(5) for t in texts[k : k + 2]]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), words=3, similarity=(9, 10)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


def test_near_dedup_of_equal_and_missing_ids(spark):
    a, b, c = ("the quick brown fox jumps over the lazy dog again and " + w * 3 for w in ("here ", "there ", "where "))
    rows = [(1, a), (1, a), (None, a), (2, b), (2, c), (None, b), (None, "other words of a text without any id"), (None, None), (None, " "), (3, ""), (4, "")]
    rows += [(None, "other words of a text without any id")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = ngram_join.near_dedup(df.withColumn("_node", F.lit("x")).drop("_node"), similarity=(99, 100)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 2, 3, 4]
    assert sorted(str(r.text) for r in got if r.doc_id is None) == [" ", "None", "other words of a text without any id"]


def test_line_dedup_of_a_document_of_many_lines(spark):
    common = [f"line number {i} of all sites" for i in range(30_000)]
    rows = [(i, "\n".join(common), f"s{i}") for i in range(12)] + [(99, "own line\n" + "\n".join(common) + "\n\nlast", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    start = time.time()
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert time.time() - start < 60  # three thousand million comparisons would take longer
    assert got[0].text == "\n".join(common) and got[0].n_removed == 0
    assert got[5].text == "" and got[5].n_removed == 30_000
    assert got[99].text == "own line\n\nlast" and got[99].n_lines == 30_003
