"""HTML extraction, personal data, fingerprints and the quality classifier."""

import hashlib
import html
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm import fingerprints, html_text, pii, quality
from fleetscope.sources.tables import read_table
from pyspark.sql import functions as F

PARAGRAPH = "The history of the town is long and it was written by the people that lived in it for most of the time. " * 3


def test_page_without_article_by_density():
    page = f"""<html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body>
    <div id="header"><a href="/">Home</a></div><ul class="main-menu"><li>One</li></ul>
    <div><h2>Heading</h2><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p><p><a href=x>Read more about this here</a></p></div>
    <div class="cookieNotice">We use cookies for the site.</div><form><input> Search the site</form>
    <div class="comments"><p>{PARAGRAPH}</p></div><footer>&copy; me</footer></body></html>"""
    want = "\n".join(["Heading", " ".join(PARAGRAPH.split()), "Short.", " ".join(PARAGRAPH.split())])
    assert html_text.main_text(page) == want


def test_article_kept_whole():
    page = (
        '<nav><ul><li><a href="/a">a</a></ul></nav><article><header><h1>A &amp; B</h1></header><p>x&nbsp; y<br>z</p><p>Be.'
        '<aside>see also</aside><p>last <b>bold</b> &lt;tag&gt; &am<!-- no --></article><div class="ad">buy</div>'
    )
    assert html_text.main_text(page) == "A & B\nx y z\nBe.\nlast bold <tag> &am"


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!-- never closed", "<script>x", "<a href='x>y", "</div></article></p>", "<div>" * 5000])
def test_broken_pages(page):
    assert html_text.main_text(page) in ("", "<", "y")


def test_undecided_blocks_take_after_the_nearest():
    assert html_text.second_pass(["good", "short", "bad", "short", "short"]) == [True, True, False, False, False]
    assert html_text.second_pass(["short", "short"]) == [True, True]
    assert html_text.second_pass(["bad", "short", "short", "good"]) == [False, False, True, True]


def test_articles_keep_their_text():
    text = html_text.main_text
    assert text('<article><p class="notice">x<p>Real text of it...</article>') == "Real text of it..."
    assert text('<article><ul><li class="share">x<li>Keep this</ul><p>Real text</article>') == "Keep this\nReal text"
    assert text('<article><p class="comment-free">One</p><p class="social-history">Two</p></article>') == "One\nTwo"
    assert text('<article><p>Some <span class="related">related</span> word.</p></article>') == "Some related word."
    assert text('<article><p>One.</p><p><a class="share" href=x>Share</a></p><p>Two <b hidden>no</b>.</p></article>') == "One.\nTwo ."
    assert text('<article><p>It is <a href=x>mostly a link inside of</a> it</p></article>') == "It is mostly a link inside of it"
    items = "".join(f"<li><a href=x>Item {i}</a>" for i in range(4))
    assert text(f"<article><h1>Title</h1><div class=share>s</div><p>the text of it</p><ul>{items}</ul></article>") == "Title\nthe text of it"
    assert text('<article><p title="a hidden thing">Kept<button>x<p>Also kept</article>') == "Kept x\nAlso kept"
    assert text("<div class=sidebar><ul><li>a</ul></div><main><div><p>One</div></div><p>Two</main>") == "One\nTwo"


BROKEN = ["<svg ", '<p "', '<p a="', "<a href='x\" ", "<!", "</", "<p <", "<div>", "<div></span>", "<script", "<p x=\"<p y='", "</svg   ", "<ul><li>", "<button>"]


@pytest.mark.parametrize("part", BROKEN)
def test_time_grows_with_the_page(part):
    for end in ("", ">", "\"'>"):
        took = []
        for size in (100_000, 800_000):
            start = time.process_time()
            html_text.main_text(part * (size // len(part)) + end)
            took.append(time.process_time() - start)
        assert took[1] < 24 * took[0] + 0.2  # 8 times the page; a quadratic reader takes 64 times


def test_pages_built_from_known_text():
    rng = random.Random(5)
    words = "the of and history town river people work years early market stone was in it".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(16, 40))).capitalize() + "."
    for _ in range(200):
        want, body = [], []
        for _ in range(rng.randint(1, 8)):
            kind = rng.choice(["p", "p", "p", "li", "furniture", "script"])
            text = sentence()
            if kind == "p":
                cut = rng.randrange(len(text))
                inner = html.escape(text[:cut]) + rng.choice(["<b>", "<i class=x>", "<!-- <p> -->", ""]) + html.escape(text[cut:])
                body.append(f"<p{rng.choice(['', ' class=lead', ' id=p1'])}>{inner}{rng.choice(['</p>', ''])}")
                want.append(text)
            elif kind == "li":
                body.append(f"<ul><li>{text}{rng.choice(['</li>', ''])}</ul>")
                want.append(text)
            elif kind == "furniture":
                name = rng.choice(["nav", "aside", "form", 'div class="ad"', "section id=comments", 'ul role="menu"'])
                body.append(f"<{name}><p>{text}</{name.split()[0]}>")
            else:
                body.append(f"<script>if (a < b) '</p>' + '{text}'</script>")
        page = f"<html><head><title>t</title></head><body><nav><a href=x>x</a></nav><article>{''.join(body)}</article><footer>f</footer>"
        assert html_text.main_text(page) == "\n".join(want), page


def test_extract_frame(spark):
    rows = [(1, "u", "<article><p>a</p></article>"), (2, None, None), (None, "u", ""), (3, "u", "<p>" + "é" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got[1, "u"] == ("a", 1) and got[2, None] == ("", 0) and got[None, "u"] == ("", 0)
    assert html_text.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def base_spans(text):
    """The base kinds by scanning the whole text."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group())):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+ -()9:%0·٣é2", max_size=80))
def test_anchors_find_what_a_scan_finds(text):
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == base_spans(text)


def test_planted_numbers():
    rnd = random.Random(3)
    for _ in range(300):
        parts = []
        for _ in range(6):
            n = "".join(rnd.choice("0123456789") for _ in range(rnd.randrange(12, 21)))
            parts += [n, "4111 1111 1111 1111", "378282246310005", "192.168.0.1", "999.1.1.1", "+1 (974) 555-3436", "x@y.zz", "5555-5555-5555-4444"]
        rnd.shuffle(parts)
        text = rnd.choice([" ", ", ", "", "-", "."]).join(parts)
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == base_spans(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and pii.luhn("378282246310005") and not pii.luhn("4111111111111112")


def test_added_kinds_and_redaction():
    text = 'a.b@c.de token = "0123456789abcdef" IBAN DE89 3704 0044 0532 0130 00, account no 12345678 ftp://u:pw@host.org/x IBAN DE00 0000 0000 0000 0000 00'
    assert [k for k, _, _ in pii.find_spans(text)] == ["email", "secret", "iban", "account", "login", "email"]
    assert pii.redact(text) == '<EMAIL> token = "<SECRET>" IBAN <IBAN>, account no <ACCOUNT> <LOGIN> IBAN DE00 0000 0000 0000 0000 00'
    assert pii.redact(None) is None and pii.redact("") == "" and pii.find_spans("tokens are fine, key: x") == []


def test_pii_frames(odd_docs, no_docs):
    out = pii.redacted(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    rows = pii.report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()} and {r.spans for r in rows} == {""}
    assert pii.report(no_docs).count() == 0 and pii.redacted(no_docs).count() == 0


def edited(docs):
    order = sorted(docs, reverse=True)
    return {
        i: t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2] for k, (i, t) in enumerate(order)
    }, {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}


def jaccard(a, b, n=5):
    def s(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("per_bucket", [1000, 7])
def test_fingerprints_estimate_similarity(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(fingerprints, "BUCKET_DOCS", per_bucket)
    rnd = random.Random(5)
    docs = [(i * i, " ".join(str(rnd.randrange(50 if i % 2 else 10**6)) for _ in range(rnd.choice([3, 40, 300])))) for i in range(1, 120)]
    docs += [(0, ""), (-5, docs[50][1]), (-9, docs[50][1]), (20_000, "édité " * 30)]
    rows = fingerprints.edited_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want, following = edited(docs)
    text = dict(docs)
    assert len(rows) == len(docs)
    assert {r.doc_id: r.edited_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert {r.doc_id: r.n_chars for r in rows} == {i: len(t) for i, t in docs}
    error = np.array([r.near_edited - jaccard(text[r.doc_id], want[r.doc_id]) for r in rows])
    assert abs(error.mean()) < 0.02 and abs(error).mean() < 0.06 and abs(error).max() < 0.3
    away = np.array([r.near_next - jaccard(text[r.doc_id], following[r.doc_id]) for r in rows])
    assert abs(away).mean() < 0.03
    by = {r.doc_id: r for r in rows}
    assert by[-5].fingerprint == by[-9].fingerprint and by[-5].near_next == 1.0
    assert by[0].fingerprint.startswith("0") and by[0].near_edited == 1.0


def test_fingerprints_odd_rows(odd_docs, no_docs):
    rows = fingerprints.edited_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.edited_report(no_docs).count() == 0 and fingerprints.fingerprints(no_docs).count() == 0
    assert len({r.fingerprint for r in fingerprints.fingerprints(odd_docs).filter("doc_id in (1, 4)").collect()}) == 1


def test_densification_takes_a_filled_bin(spark):
    one = spark.createDataFrame([("single",)], "t string")
    bins = fingerprints.with_fingerprint(one, "t", "f").first().f
    assert len(bins) == fingerprints.BINS and len(set(bins)) > 80
    two = spark.createDataFrame([("single", "other"), ("single", "single")], "t string, u string")
    both = fingerprints.with_fingerprint(fingerprints.with_fingerprint(two, "t", "f"), "u", "g")
    assert [r.n for r in both.select(fingerprints.likeness(F.col("f"), F.col("g")).alias("n")).collect()] == [pytest.approx(0, abs=0.05), 1.0]


def auc(y, s):
    import pandas as pd

    rank = pd.Series(s).rank().to_numpy()
    good = y == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels", "doc_id", "quality")
    out = quality.scored(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()
    both = out.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(held) > 50 and auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.97
    assert (held.predicted == held.quality).mean() > 0.95
    assert held.predicted[held.quality == 1].mean() > 0.95


def test_quality_scores_row_by_row(spark):
    rules = {(("chars", "<=", 1.5), ("words", ">", 0.5)): 0.7, (("mark_share", ">", 0.2),): -1.25, (("longest_word", "<=", 3.0),): 0.5}
    rng = random.Random(3)
    rows = [tuple(rng.choice([0.0, 0.2, 0.5, 1.5, 3.0, rng.random() * 4]) for _ in quality.STATISTICS) for _ in range(500)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in quality.STATISTICS))
    for r in df.withColumn("score", quality.compiled(-0.3, rules)).collect():
        total = -0.3
        for rule, weight in rules.items():
            total += weight if all(r[c] <= x if op == "<=" else r[c] > x for c, op, x in rule) else 0.0
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-12


def test_quality_kept_is_what_scored_predicts(spark, sf_small):
    docs, labels = read_table(spark, sf_small, "documents"), read_table(spark, sf_small, "labels", "doc_id", "quality")
    odd = labels.unionByName(labels.limit(20).withColumn("quality", F.lit(7)))
    want = {r.doc_id for r in quality.scored(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in quality.kept(docs, odd).collect()} == want


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, None), (None, 1)], "doc_id long, quality long")
    out = quality.scored(odd_docs, labels)
    assert out.count() == odd_docs.count() and out.filter("score is null or predicted is null or held_out is null").count() == 0
    none = quality.scored(odd_docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {1.0}
    assert quality.kept(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert quality.kept(odd_docs, labels.limit(0)).columns == odd_docs.columns
    assert quality.scored(no_docs, labels).count() == 0


def test_tree_rules():
    text = """Model
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 1 <= 1.0)
      Predict: 0.0
     Else (feature 1 > 1.0)
      Predict: 1.0
    Else (feature 0 > 2.5)
     Predict: 1.0
"""
    a, b = quality.STATISTICS[:2]
    assert quality.tree_rules(text) == [
        ((a, "<=", 2.5),), tuple(sorted([(a, "<=", 2.5), (b, "<=", 1.0)])), tuple(sorted([(a, "<=", 2.5), (b, ">", 1.0)])), ((a, ">", 2.5),)
    ]


@pytest.mark.parametrize("kind", ["spread", "outlier", "string"])
def test_next_document_with_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "BUCKET_DOCS", 20)
    rng = random.Random(4)
    ids = rng.sample(range(1, 10_000), 300)
    ids = ids + [10**18] if kind == "outlier" else [rng.randrange(-(2**63), 2**63) for _ in ids] if kind == "spread" else [f"{x:x}é" for x in ids]
    rows = [(i, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 40)))) for i in ids]
    df = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'string' else 'long'}, text string").repartition(5)
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_report(df).collect()}
    down = sorted(rows, key=lambda r: r[0].encode() if kind == "string" else r[0], reverse=True)
    for (i, text), (_, after) in zip(down, down[1:] + down[:1], strict=True):
        half = len(text) // 2
        assert got[i] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    dealt = fingerprints.in_ranges(df, "doc_id", F.lit(0)).filter("_copy = 0").groupBy("_bucket").count().toPandas()
    assert dealt["count"].max() < 150
