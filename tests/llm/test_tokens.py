"""Token files, packing, and SentencePiece encoding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm import arrow_tokens, packing, pieces, tokens

TEXT = st.text(alphabet="abÀé'sS.,!\n\t  ́ ßΣ中\x01<|>end0", max_size=60)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_ids_equal_the_library(texts):
    enc = tokens.encoder(tokens.vocabulary_path())
    ids, n = enc.encode(pa.array(texts, pa.large_string()))
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == list(map(len, want))


def test_special_strings_and_contractions(library):
    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|>", "Don's, can't. I'LL!! 'tis", "x.'s y", "A,b, c,\n", "ΣΑΣ, ÉTÉ."]
    enc = tokens.Encoder(tokens.vocabulary_path())
    for t in texts:
        assert enc.encode(pa.array([t], pa.large_string()))[0].tolist() == library.encode(t, add_special_tokens=False).ids


def expected(library, docs):
    out, start = {}, 0
    for i, t in sorted(docs):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, library):
    rnd = random.Random(2)
    docs = [(i * 7 % 501, " ".join(rnd.choice(["the", "Of", "x9", "été,", '"']) for _ in range(rnd.choice([0, 1, 50, 5000])))) for i in range(200)]
    docs += [(1000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    folder, manifest = arrow_tokens.write_tokens(df, length=256)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in arrow_tokens.read_documents(folder, manifest).collect()}
    want = expected(library, docs)
    assert got == want
    files = manifest.orderBy("shard").collect()
    assert sum(f.n_tokens for f in files) == sum(n for _, n, _ in want.values())
    reader = arrow_tokens.TokenReader(pa.memory_map(f"{folder}/{files[0].ids_file}"))
    flat = reader.span(0, files[0].n_tokens)
    last = (files[0].n_tokens - 1) // 256
    for row in {0, last // 2, last}:
        mask = reader.mask(row)
        assert (reader.sequence(row)[mask] == flat[row * 256 : row * 256 + mask.sum()]).all()
        assert mask.sum() == min(256, files[0].n_tokens - row * 256)


def test_token_files_odd_rows(odd_docs, no_docs):
    folder, manifest = arrow_tokens.write_tokens(odd_docs)
    rows = arrow_tokens.read_documents(folder, manifest).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.start for r in rows)[0] == 0 and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 6)} == {1}
    folder, manifest = arrow_tokens.write_tokens(no_docs)
    assert manifest.count() == 0 and arrow_tokens.read_documents(folder, manifest).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_solution_covers_exactly(histogram):
    plan = packing.solve(histogram, capacity=64, rounds=8)
    got = Counter()
    for chosen, times in plan:
        assert sum(chosen) <= 64 and times > 0
        for x in chosen:
            got[x] += times
    assert got == Counter(histogram)
    used = sum(t for _, t in plan)
    bound = -(-sum(k * n for k, n in histogram.items()) // 64)
    first_fit = []
    for x in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        at = next((i for i, r in enumerate(first_fit) if r >= x), None)
        if at is None:
            first_fit.append(64 - x)
        else:
            first_fit[at] -= x
    assert bound <= used <= len(first_fit) * 1.1 + 1


def test_knapsack_against_brute_force():
    rnd = random.Random(4)
    for _ in range(20):
        price = np.zeros(31)
        for x in rnd.sample(range(1, 31), 5):
            price[x] = rnd.random()
        value, last = packing.best_fill(price, 30)
        best = [0.0] * 31
        for room in range(1, 31):
            best[room] = max([best[room - 1], *(best[room - x] + price[x] for x in range(1, room + 1) if price[x])])
        assert np.allclose(value, best)
        assert np.isclose(sum(price[x] for x in packing._taken(last, 30)), best[30])


def check_packed(rows, capacity):
    by, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        spans[r.doc_id].append((r.piece, r.start, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return by, spans


def test_packing(spark, library):
    rnd = random.Random(6)
    docs = [(i, " ".join(["the"] * rnd.choice([0, 3, 40, 41, 100, 700]))) for i in range(300)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=128).collect()
    by, spans = check_packed(rows, 128)
    want = expected(library, docs)
    for i, parts in spans.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and [s for _, s, _ in parts] == [128 * k for k in range(len(parts))]
        assert sum(n for _, _, n in parts) == want[i][1] and all(n == 128 for _, _, n in parts[:-1])
    total = sum(n for _, n, _ in want.values())
    assert len(by) <= 1.03 * -(-total // 128) + 1


def test_packing_hot_length_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 50)
    docs = [(i, "the " * (20 if i % 3 else i % 90)) for i in range(600)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=64).collect()
    check_packed(rows, 64)
    assert len(rows) >= 600


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    check_packed(rows, 4096)
    assert {r.length for r in rows if r.doc_id in (2, 3, 6)} == {1}
    assert packing.pack(no_docs).count() == 0
    whole = packing.sequences(odd_docs).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in rows)


PIECES = st.text(alphabet="theaniours ÀéH.,\n\t中😀　\x1f1", max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4))
def test_rate_zero_is_the_library(texts):
    import sentencepiece

    path = tokens.vocabulary_path("piece_bpe_32k.model")
    voc = pieces.vocabulary(path, 0.0, 0)
    if not hasattr(voc, "library"):
        voc.library = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, n = voc.encode(pa.array(texts, pa.large_string()), np.arange(len(texts), dtype=np.uint64), 0.0, 0, 1)
    assert ids.tolist() == [i for t in texts for i in voc.library.encode(t)]


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES | st.text(max_size=30), min_size=1, max_size=4), st.sampled_from([0.05, 0.3, 0.9]))
def test_dropout_is_lossless(texts, rate):
    voc = pieces.vocabulary(tokens.vocabulary_path("piece_bpe_32k.model"), rate, 3)
    ids, n = voc.encode(pa.array(texts, pa.large_string()), np.arange(len(texts), dtype=np.uint64), rate, 3, 4)
    ends = np.cumsum(n)
    assert [voc.decode(ids[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)] == texts


def test_dropout_varies_and_repeats(spark):
    docs = [(i, "the theory of everything together " * 20) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = {r.doc_id: tuple(r.ids) for r in pieces.encoded(df).collect()}
    two = {r.doc_id: tuple(r.ids) for r in pieces.encoded(df.repartition(7)).collect()}
    other = {r.doc_id: tuple(r.ids) for r in pieces.encoded(df, seed=99).collect()}
    assert one == two and one != other and len(set(one.values())) > 10
    plain = {tuple(r.ids) for r in pieces.encoded(df, rate=0.0).collect()}
    assert len(plain) == 1 and all(len(x) >= len(next(iter(plain))) for x in one.values())
    back = pieces.decoded(pieces.encoded(df)).collect()
    assert {r.text for r in back} == {docs[0][1]}


def test_sentencepiece_odd_rows(odd_docs, no_docs):
    rows = pieces.round_trip(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.lossless for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (2, 3)} == {0}
    assert pieces.round_trip(no_docs).count() == 0


def test_dropout_draws_for_each_occurrence():
    path = tokens.vocabulary_path("piece_bpe_32k.model")
    voc = pieces.vocabulary(path, 0.1, 5)
    word, n = " the", 20_000
    plain, taken = voc.segment(word)
    assert taken >= 2
    ids, sizes = voc.encode(pa.array([word.strip() + word * (n - 1)], pa.large_string()), np.array([7], np.uint64), 0.1, 5)
    want = Counter()
    for r in range(1 << 12):  # all sets of skips up to twelve candidates, with their chances
        skips = {k for k in range(12) if r >> k & 1}
        out, used = voc.segment(word, skips)
        if all(k < used for k in skips):
            want[tuple(out)] += 0.1 ** len(skips) * 0.9 ** (used - len(skips))
    assert abs(sum(want.values()) - 1) < 1e-9
    got = Counter()
    starts = [i for i, piece in enumerate(ids.tolist()) if voc.raw[voc.raw_first[piece]] == 32] + [len(ids)]
    for a, b in zip(starts, starts[1:], strict=False):
        got[tuple(ids[a:b].tolist())] += 1
    assert sum(got.values()) == n and len(got) > 4 and set(got) <= set(want)
    for k, chance in want.items():
        assert abs(got[k] - n * chance) < 5 * (n * chance) ** 0.5 + 1, (k, chance, got[k])


def test_words_with_few_merges_vary():
    voc = pieces.vocabulary(tokens.vocabulary_path("piece_bpe_32k.model"), 0.1, 5)
    words = [w for a in "abcdefghijklmnopqrstuvwxyz" for w in (" " + a,) if voc.segment(w)[1] == 1]
    assert len(words) > 10
    for w in words:  # a tenth of the occurrences, of every word
        ids, n = voc.encode(pa.array([w.strip() + w * 999, "x" + w * 1000], pa.large_string()), np.array([1, 2], np.uint64), 0.1, 5)
        assert 2 * 1000 + 130 < len(ids) < 2 * 1000 + 270
        assert ids[: n[0]].tolist() != ids[n[0] :].tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="theaniours ÀéH.,\t中😀▁\ufffe", min_size=1, max_size=30), st.sets(st.integers(0, 60)))
def test_list_and_heap_agree(chunk, skips):
    voc = pieces.vocabulary(tokens.vocabulary_path("piece_bpe_32k.model"), 0.0, 0)
    text = chunk.replace("▁", "\ufffe").replace(" ", "▁")
    assert voc.segment(chunk, skips) == voc._by_heap(chunk, text, skips)


def test_dropout_of_long_chunks():
    voc = pieces.vocabulary(tokens.vocabulary_path("piece_bpe_32k.model"), 0.1, 5)
    texts = ["theory" * 2000, "theory" * 2000, "the " * 5]
    ids, n = voc.encode(pa.array(texts, pa.large_string()), np.arange(3, dtype=np.uint64), 0.1, 5)
    ends = np.cumsum(n)
    parts = [ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
    assert [voc.decode(p) for p in parts] == texts and parts[0].tolist() != parts[1].tolist()
    assert len(parts[0]) > 1.1 * len(voc.segment(" " + texts[0])[0])
    for rate in (0.001, 0.1, 0.9, 1.0):
        far = pieces.Draws(rate)
        skips = far.skips(np.uint64(3), 100_000)
        assert abs(sum(x < 100_000 for x in skips) - 100_000 * rate) <= 5 * (100_000 * rate) ** 0.5 * (rate < 1)


def test_cut_character_changes_no_neighbour():
    voc = pieces.vocabulary(tokens.vocabulary_path("piece_bpe_32k.model"), 0.3, 5)
    clean, odd = "one,two. (three) four;five " * 20, "one,two.\x1f\x01 (three)\x1fx"
    encode = lambda texts, keys: voc.encode(pa.array(texts, pa.large_string()), np.array(keys, np.uint64), 0.3, 5)
    alone, n = encode([clean], [4])
    ids, m = encode([odd, "", clean, odd], [3, 9, 4, 3])
    assert ids[m[:2].sum() :][: m[2]].tolist() == alone.tolist() and n[0] == m[2]
    assert ids[: m[0]].tolist() == ids[-m[3] :].tolist() and voc.decode(ids[: m[0]]) == odd
    chunks = voc._chunks(pa.array([odd, odd.replace("\x1f", "\x02")], pa.large_string())).to_pylist()
    assert [c.replace("\x1f", "\x02") for c in chunks[0]] == chunks[1]


def test_ids_of_a_large_vocabulary_are_stored_whole(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {"\x01": 0, "[UNK]": 1} | {f"w{i}": i for i in range(2, 70_000)}
    library = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "words.json")
    library.save(path)
    docs = [(i, f"w{65_530 + i} w7 w{i + 2}") for i in range(20)]
    folder, manifest = arrow_tokens.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary=path, length=8)
    got = {r.doc_id: r.ids_crc32 for r in arrow_tokens.read_documents(folder, manifest).collect()}
    assert got == {i: zlib.crc32(np.array([65_530 + i, 7, i + 2, 1], "<u4").tobytes()) for i, _ in docs}


def test_an_id_that_does_not_fit_is_an_error():
    sink = pa.BufferOutputStream()
    out = arrow_tokens.TokenWriter(sink, 4)
    out.add(np.array([1, 70_000], np.uint32))
    with pytest.raises(OverflowError):
        out.close()
