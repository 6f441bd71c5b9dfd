"""The queries of this subpackage: ``QUERIES`` by name, ``ORACLES`` where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import (
    alignment,
    arrow_tokens,
    context_mixing,
    exact_dedup,
    fingerprints,
    html_text,
    line_dedup,
    ngram_join,
    packing,
    phrases,
    pieces,
    pii,
    quality,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLES["op3_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op6_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = arrow_tokens.write_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return arrow_tokens.read_documents(folder, manifest)


@_query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(read_table(spark, sf_dir, "documents", "doc_id", "text"), words=3, similarity=(9, 10))


@_query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


@_query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLES["op10_line_dedup"] = f"""
WITH lines AS (
    SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents
), common AS (
    SELECT trim(line) AS body, min((doc_id, pos)) AS first
    FROM lines WHERE trim(line) <> ''
    GROUP BY 1 HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}
), marked AS (
    SELECT l.*, c.body IS NOT NULL AND (l.doc_id, l.pos) <> c.first AS gone
    FROM lines l LEFT JOIN common c ON trim(l.line) = c.body
)
SELECT d.doc_id, count(m.pos) AS n_lines, count(*) FILTER (m.gone) AS n_removed,
       CASE WHEN any_value(d.text) IS NOT NULL
            THEN coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT m.gone), '') END AS text
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id
GROUP BY d.doc_id
"""


@_query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.scored(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


@_query
def op7_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents", "text", "lang"))


ORACLES["op11_phrase_collocations"] = phrases.ORACLE


@_query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(read_table(spark, sf_dir, "documents", "doc_id", "text"))
