"""Phrase collocations, tokenizer alignment and context mixing against brute-force versions."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetscope.llm import alignment, context_mixing, phrases
from fleetscope.llm import words as wd
from fleetscope.llm.tokens import vocabulary_path
from fleetscope.sources.tables import read_table

SF = "/root/testdata/sf0.001"
TEXT = st.text(alphabet="abAB É中 .,\n\t\x0b!", max_size=40)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- words ---------------------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_words_of_pieces(texts):
    some = wd.split(pa.array(texts, pa.large_string()))
    at, found = wd.coded(some)
    want = [(i, w, j == 0) for i, t in enumerate(texts) for p in re.split(r"[.,;:!?\x0a-\x0d]", lower(t)) for j, w in enumerate(re.findall(r"[^ \t]+", p))]
    assert [(i, found[k], b) for i, k, b in zip(some.text.tolist(), at.tolist(), some.broken.tolist(), strict=True)] == want


def test_slices_cover_all_texts():
    texts = pa.array(["", "a" * 10, "b" * 3, "", "c" * 3, "d" * 30, ""], pa.large_string())
    assert list(wd.slices(texts, 6)) == [(0, 1), (1, 2), (2, 5), (5, 6), (6, 7)]


# --- phrases -------------------------------------------------------------------------------------------------

def brute_phrases(docs, least, most, top):
    counts, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            ws = tuple(re.findall(r"[^ \t]+", piece))
            total[lang] += len(ws)
            for k in range(1, most + 1):
                counts.update((lang, ws[i : i + k]) for i in range(len(ws) - k + 1))
    found = defaultdict(list)
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    some = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    for (lang, g), a in some.items():
        if any(h[0] == lang and len(h[1]) > len(g) and 100 * b >= 100 * a and inside(g, h[1]) for h, b in some.items()):
            continue
        cuts = [(math.floor(Fraction(1000 * a * total[lang], counts[lang, g[:k]] * counts[lang, g[k:]])), k) for k in range(1, len(g))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]]))
    return {(lang, i, p.decode(), -a, le, r, total[lang], -s) for lang, x in found.items() for i, (s, a, p, le, r) in enumerate(sorted(x)[:top], 1)}


@pytest.mark.parametrize("seed", [1])
def test_phrases_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(wd, "SHARD_TEXTS", 7)  # many shards
    rnd = random.Random(seed)
    docs = [(" ".join(rnd.choice(["a", "B", "b", "c", "of the", "x. y", "É", "a, a a a"]) for _ in range(rnd.randrange(40))), rnd.choice(["en", "fr", None])) for _ in range(120)]
    docs += [(None, "en"), ("", None), ("a a a a a a a", "de")] + [("of the same words again and again", "en")] * 9
    df = spark.createDataFrame(docs, "text string, lang string").withColumn("n", F.lit("own")).repartition(4)
    for least, top in ((4, 25), (9, 2000)):
        got = {tuple(r) for r in phrases.collocations(df, min_count=least, top=top).collect()}
        assert got == brute_phrases(docs, least, 5, top)


def test_phrases_of_nothing(spark, odd_docs, no_docs):
    odd = odd_docs.withColumn("lang", F.col("n_lines"))
    got = {tuple(r) for r in phrases.collocations(odd).collect()}
    assert len(got) == 4 and got == brute_phrases([(r.text, r.lang) for r in odd.collect()], 100, 5, 2000)
    none = phrases.collocations(no_docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and none.count() == 0


@pytest.mark.parametrize("most", [2, 3, 6])
def test_phrases_travel_as_lists(spark, monkeypatch, most):
    """A shard has a row for each round, however many phrases it has; phrases of other lengths are found too."""
    monkeypatch.setattr(wd, "SHARD_TEXTS", 20)
    rows = []

    def watched(df, name, **how):
        out = written(df, name, **how)
        rows.append((name, out.count()))
        return out

    written = phrases.written
    monkeypatch.setattr(phrases, "written", watched)
    rnd = random.Random(7)
    docs = [(" ".join(rnd.choice("abcdefg") for _ in range(30)), "en") for _ in range(100)]
    got = {tuple(r) for r in phrases.collocations(spark.createDataFrame(docs, "text string, lang string").coalesce(1), min_count=4, max_words=most).collect()}
    assert len(got) > 40 and got == brute_phrases(docs, 4, most, 2000)
    assert all(n <= 10 for name, n in rows if name != "phrase-names")  # 5 shards, two lengths


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_index_extends_both_ways(ids):
    seq = np.array([0, *ids, 0], np.int32)
    index = phrases.Index.of(seq, 4)
    n_symbols = len(index.count)
    level = {(s,): (int(index.first[s]), int(index.first[s]), int(index.count[s])) for s in range(1, n_symbols) if index.count[s]}
    for k in range(2, 5):
        names = list(level)
        if not names:
            break
        order = np.argsort([level[g][0] for g in names])
        names = [names[i] for i in order]
        head, tail, lo, rlo, n = index.extend(*(np.array([level[g][j] for g in names]) for j in range(3)))
        level = {(*names[h], names[t][-1]): (a, b, c) for h, t, a, b, c in zip(head.tolist(), tail.tolist(), lo.tolist(), rlo.tolist(), n.tolist(), strict=True)}
        assert all(names[h][1:] == names[t][:-1] for h, t in zip(head.tolist(), tail.tolist(), strict=True))
        want = Counter(tuple(seq[i : i + k].tolist()) for i in range(len(seq) - k + 1) if (seq[i : i + k] > 0).all())
        assert {g: x[2] for g, x in level.items()} == want


# --- alignment -----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def groups(libraries, text):
    """[(A ids, B ids)] by the libraries, one token at a time."""
    if not text:
        return []
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    bytes_a = [bytes(byte[c] for c in libraries[0].id_to_token(i)) for i in a]
    piece = libraries[1].id_to_piece
    bytes_b = [bytes([int(piece(i)[3:5], 16)]) if libraries[1].is_byte(i) else piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    out, end_a, end_b, own = [], 0, 0, ([], [])
    i = j = 0
    while i < len(a) or j < len(b):
        if end_a <= end_b:
            end_a += len(bytes_a[i])
            own[0].append(a[i])
            i += 1
        else:
            end_b += len(bytes_b[j])
            own[1].append(b[j])
            j += 1
        if end_a == end_b:
            out.append(own)
            own = ([], [])
    return out


ODD = ["▁a", "a ▁", " ", "\n", "  a  b\n\n c", "\x1f x y.", "<|endoftext|> hi</s>", "can't, won't. I'll!!  \t x  y", "é中文字 🙂.", "a\tb \t  c", "﻿x", "   . x",
       "12,345.67 (ok) [x] a's, 's"]


def test_alignment_equals_the_libraries(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 3000)
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents", "doc_id", "text").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate([None, "", *ODD])] + [(None, "no id"), (5, "twice"), (5, "twice")]
    want, pairs = [], Counter()
    for _, text in docs:
        g = groups(libraries, text)
        want.append(g)
        pairs.update((a[-1], b[-1]) for a, b in g)
    best = Counter()
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    rows = Counter()
    for (i, _), g in zip(docs, want, strict=True):
        links = [(a[-1], b[-1]) for a, b in g]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows[i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links),
             hashlib.sha256(told.encode()).hexdigest() if g else ""] += 1
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("own")).repartition(5)
    got = alignment.aligned(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r) for r in got.collect()) == rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abÀé'sS.,!(1 \n\t  ▁\x01\x1f<|>中🙂", max_size=40), max_size=5))
def test_alignment_of_odd_texts(libraries, texts):
    both = alignment.aligner(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    found = both.align(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        g = groups(libraries, t)
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        assert (found["n_a"][i], found["n_groups"][i], found["groups_sha256"][i]) == (
            sum(len(a) for a, _ in g), len(g), hashlib.sha256(told.encode()).hexdigest() if g else "")


def test_alignment_of_nothing(spark, no_docs):
    out = alignment.aligned(no_docs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and out.count() == 0


# --- context mixing ------------------------------------------------------------------------------------------

def toy_model(words, counts):
    """A model trained in one place, with dictionaries for counts."""
    histogram = np.zeros(256, np.int64)
    for w, c in zip(words, counts, strict=True):
        for s in w if w == b"\n" else w + b" ":
            histogram[s] += c
    code = context_mixing.Code(histogram)
    some = context_mixing.Spelled(words, code)
    tables, known = [], None
    for number, hashed in enumerate(some.contexts()):
        n = np.zeros((2, 1 << context_mixing.TABLE_BITS[number]))
        for slot, bit, c in zip(some.slots(hashed, context_mixing.TABLE_BITS[number]), some.bit, np.repeat(counts, some.n_bits), strict=True):
            n[bit][slot] += c
        tables.append(np.clip(np.rint(np.log((n[1] + context_mixing.DELTA) / (n[0] + context_mixing.DELTA)) * context_mixing.SCALE), -127, 127).astype(np.int8))
        known = np.digitize(n.sum(axis=0), context_mixing.COUNTS).astype(np.uint8)
    return context_mixing.Model(code, tables, known)


def one_by_one(model, words, probability=None):
    """log10 of the probability of one text, a bit at a time; also each bit's probability of 1."""
    cm, mask = context_mixing, 0xFFFFFFFF
    log, before = 0.0, 0
    for t, w in enumerate(words):
        if t % cm.SEGMENT_WORDS == 0:
            weights, fix, own = model.weights.copy(), defaultdict(float), [defaultdict(float), defaultdict(float)]
        later = []
        for p in range(model.some.first_bit[w], model.some.first_bit[w] + model.some.n_bits[w]):
            hashed, shift = int(model.own[p]), 32 - cm.OWN_BITS
            a, b = hashed >> shift, ((hashed ^ ((before * 0x2545F491 + 1) & mask)) * 0x9E3779B1 & mask) >> shift
            x = np.array([*(model.inputs[:, p] / cm.SCALE), own[0][a], own[1][b], cm.BIAS])
            g = int(model.gate[p]) + (own[0][a] != 0) + (own[1][b] != 0)
            dot = np.clip(weights[g] @ x, -12, 11.9)
            one = 1 / (1 + math.exp(-(dot + fix[int(dot + 12)])))
            bit = int(model.some.bit[p])
            if probability is not None:
                probability.append(one)
            log += math.log10(max(1 - abs(bit - one), 1e-7))
            later.append((g, x, int(dot + 12), a, b, own[0][a], own[1][b], bit, bit - one))
        for g, x, cell, a, b, seen_a, seen_b, bit, error in later:  # the model learns after the word
            weights[g] += error * cm.RATE * x
            fix[cell] += error * cm.CORRECTION_RATE
            for table, at, seen in ((own[0], a, seen_a), (own[1], b, seen_b)):
                table[at] = seen + ((2 * bit - 1) * cm.OWN_LIMIT - seen) * cm.OWN_RATE
        before = int(model.word[w])
    return log


def test_mixing_many_segments_equals_one_by_one(monkeypatch):
    monkeypatch.setattr(context_mixing, "SEGMENT_WORDS", 70)
    monkeypatch.setattr(context_mixing, "LANES", 5)
    rnd = random.Random(4)
    words = [b"the", b"then", b"of", "é中".encode(), b"a", b"zebra", b"\n"]
    model = toy_model(words[:5] + words[-1:], [9, 3, 30, 1, 700, 4])
    model.spelled(words)
    texts = [[rnd.randrange(6) for _ in range(n)] + [6] for n in (0, 1, 3, 90, 400, 20)]
    flat = np.array(sum(texts, []), np.int64)
    got = model.bits(flat, np.repeat(np.arange(len(texts)), list(map(len, texts))), len(texts))
    np.testing.assert_allclose(got, [one_by_one(model, t) for t in texts], rtol=2e-4)


def test_mixing_few_segments_and_words_at_a_time(monkeypatch):
    """The tables of the text are followed for a few segments and steps, and words are spelled in parts; both change no score."""
    rnd = random.Random(5)
    words = [b"the", b"then", b"of", "é中".encode(), b"a" * 60, b"zebra", b"\n"]
    texts = [[rnd.randrange(6) for _ in range(n)] + [6] for n in (0, 1, 3, 90, 400, 20, 700)]
    flat, text = np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), list(map(len, texts)))
    model = toy_model(words[:5] + words[-1:], [9, 3, 30, 1, 700, 4])
    monkeypatch.setattr(context_mixing, "SEGMENT_WORDS", 50)
    for spelled, lanes, own, steps in ((8000, 256, 64, 16), (2, 7, 3, 4), (1, 4, 1, 1)):
        for name, value in (("SPELLED_WORDS", spelled), ("LANES", lanes), ("OWN_LANES", own), ("OWN_STEPS", steps)):
            monkeypatch.setattr(context_mixing, name, value)
        model.spelled(words)
        np.testing.assert_allclose(model.bits(flat, text, len(texts)), [one_by_one(model, t) for t in texts], rtol=2e-4)


def test_mixing_holds_the_tables_of_few_segments():
    """The tables of 1024 segments are 64 MB, which no cache holds."""
    words = [b"the", b"of", b"\n"]
    model = toy_model(words, [9, 3, 4])
    model.spelled(words)
    flat, text = np.tile([0, 1, 0, 2], 1024), np.repeat(np.arange(1024), 4)
    tracemalloc.start()
    try:
        model.bits(flat, text, 1024)
        assert tracemalloc.get_traced_memory()[1] < 24e6
    finally:
        tracemalloc.stop()


def test_mixing_splits_texts_in_parts(monkeypatch):
    texts = pa.array(["", "One two", " ", "é 中\n", "", "three"] * 7, pa.large_string())
    monkeypatch.setattr(context_mixing, "SPLIT_BYTES", 8)
    for some in (texts, texts.slice(5, 4), texts.slice(0, 1)):
        for got, want in zip(context_mixing._split(some), wd.split(some, context_mixing.SPACES, b""), strict=True):
            np.testing.assert_array_equal(got, want)


def test_mixing_is_a_distribution_over_symbols():
    """After any begin, the probabilities of all 256 next symbols sum to 1: the model learns after a word, not within."""
    firsts = [s for s in range(256) if s not in (10, 32)]
    model = toy_model([b"ab", b"b", b"\n"], [5, 2, 3])
    model.spelled([b"ab", *[b"b" + bytes([s]) for s in firsts], b"b"])
    total = 0.0
    for i in range(1, len(firsts) + 2):
        probability = []
        one_by_one(model, [0, 0, i], probability)
        own = probability[-model.some.n_bits[i] :]
        begin = model.code.length[ord("b")]
        next_bits = model.code.length[firsts[i - 1] if i <= len(firsts) else 32]
        bits = model.some.bit[model.some.first_bit[i] :]
        total += math.prod(p if b else 1 - p for p, b in zip(own[begin : begin + next_bits], bits[begin : begin + next_bits], strict=True))
    assert 0.97 < total < 1 + 1e-6  # the end of a text cannot follow within a word, and has the rest


def test_mixing_base_scores_and_held_out(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents", "doc_id", "text").union(odd_docs.select("doc_id", "text")).collect()]
    split = [(i, re.findall(r"[^ \t-\r]+", lower(t))) for i, t in docs]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, ws in split if not held(i) for w in [*ws, "\n"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, ws in split:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, "\n"])
        want[i, held(i), len(ws) + 1, sum(w in counts for w in [*ws, "\n"]), n, f"{base:.6f}"] += 1
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("own"))
    got = context_mixing.scored(df.repartition(6)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}") for r in got) == want
    again = {(r.doc_id, r.n_tokens): r.score for r in context_mixing.scored(df.coalesce(1)).collect()}
    assert all(math.isclose(r.score, again[r.doc_id, r.n_tokens], rel_tol=1e-3) for r in got)  # any partitioning
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    long = max(got, key=lambda r: r.n_tokens)
    assert long.score > 0.1 * long.base_score  # one word 60,000 times


def test_mixing_without_training_rows(spark, no_docs):
    assert context_mixing.scored(no_docs).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = context_mixing.scored(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in got] == [(0, 0, 0.0)] * 3 and all(r.score < 0 for r in got)
