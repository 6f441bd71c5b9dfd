"""Personal data by anchor expansion.

One Aho-Corasick pass over the text finds anchors: at-signs, plus signs, digits, scheme marks and cue words. At each
anchor a local parser expands to the boundaries of the candidate and validates it. A base match lies wholly inside one
run of its own alphabet, so parsing run by run from the anchors gives the leftmost non-overlapping matches that a scan
of the whole text with the base patterns would give; candidates that fail validation are dropped without a retry.

Base kinds: email, ip, card, phone. Added by cue or scheme: secret (a key, token or password with its value), login
(a URL with user and password), iban (checked mod 97), account (a number after an account cue). Offsets are code
points, end exclusive.

Defined cases: null and empty text have no spans; a text of any length is read whole; repeated rows give a row each;
an empty table gives an empty result. :func:`redacted` keeps all columns; null text stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "login", "iban", "account")
KINDS = BASE + ADDED

SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access key", "private key")
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN, _IP = re.compile(r"[0-9.]+"), re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD_RUN, _CARD = re.compile(r"[0-9 -]+"), re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"""["']?\s{0,4}[=:]\s{0,4}["']?([A-Za-z0-9_\-+/=.]{8,})""")
_IBAN = re.compile(r"[\s:#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s{1,4}(?:no\.?|nr\.?|number|num\.?))?[\s:#=]{1,4}([0-9][0-9 -]{4,18}[0-9])(?![0-9])")
_LOGIN = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for c in "0123456789":
        out.add_word(c, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    out.add_word("://", ("scheme", 3))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("iban", ("iban",))):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                out.add_word(form, (kind, len(cue)))
    out.make_automaton()
    return out


_ANCHORS = None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then in the order of KINDS."""
    global _ANCHORS
    if not text:
        return []
    if _ANCHORS is None:
        _ANCHORS = _automaton()
    found: list[tuple[int, int, int]] = []
    email_end = phone_end = ip_end = card_end = added_end = 0
    for last, (anchor, size) in _ANCHORS.iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at >= card_end:
                card_end = _CARD_RUN.match(text, at).end()
                for m in _CARD.finditer(text, at, card_end):
                    digits = _digits(m.group())
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((m.start(), 2, m.end()))
            if at >= ip_end:
                ip_end = _IP_RUN.match(text, at).end()
                for m in _IP.finditer(text, at, ip_end):
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
                        found.append((m.start(), 1, m.end()))
        elif anchor == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append((start, 0, email_end))
        elif anchor == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= len(_digits(m.group())) <= 15:
                    found.append((at, 3, phone_end))
        elif at >= added_end:
            if anchor == "scheme":
                start = at
                while start > added_end and text[start - 1].isalnum():
                    start -= 1
                if start < at and (m := _LOGIN.match(text, at)):
                    added_end = m.end()
                    found.append((start, 5, added_end))
                continue
            if at and (text[at - 1].isalnum()):
                continue
            pattern, kind = {"secret": (_SECRET, 4), "iban": (_IBAN, 6), "account": (_ACCOUNT, 7)}[anchor]
            m = pattern.match(text, last + 1)
            if m and (kind != 6 or _iban_valid(m.group(1))):
                added_end = m.end(1)
                found.append((m.start(1), kind, added_end))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def redact(text: str | None) -> str | None:
    """The text with each span (overlapping ones as one) replaced by the kind that starts first, as <EMAIL>."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"<{kind.upper()}>"]
        at, k = end, k + 1
    return "".join(out) + text[at:]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``spans``, an array of (kind, start, end)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _SPAN)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the spans in ``text_col`` replaced."""
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            yield b.set_column(at, b.schema.field(at), pa.array([redact(t) for t in column.to_pylist()], column.type))

    return docs.mapInArrow(scan, docs.schema)


def span_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, a digest of the base spans and the text of all spans."""
    found = spans(docs, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col, *map(count, BASE), F.sha2(span_text(F.col("spans"), BASE), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )
