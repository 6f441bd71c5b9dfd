"""The pipeline's stages on the smallest tables, and the registered queries."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fleetscope.llm import line_dedup, packing
from fleetscope.llm.queries import ORACLES, QUERIES
from fleetscope.sources.tables import read_table, table_path

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from oracle_check import digest  # noqa: E402
from test_dedup import brute_components, brute_lines  # noqa: E402


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(QUERIES) <= names and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest([d[0] for d in cur.description], cur.fetchall())[0]


def test_stages(spark, sf_small):
    docs = read_table(spark, sf_small, "documents")
    seen = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, sf_small)
    labels = {r.doc_id: r.quality for r in read_table(spark, sf_small, "labels").collect()}
    left = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)
    assert sum(i in left for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())

    lines = {r.doc_id: r.text for r in stages["line_dedup"](spark, docs, sf_small).collect()}
    want = brute_lines([(r.doc_id, r.text, r.source) for r in seen.values()], line_dedup.MIN_SITES)
    assert lines == {i: t for i, (t, _, gone) in want.items() if not gone or t.strip(" ")}

    near = {r.doc_id for r in stages["ngram_jaccard_join"](spark, docs, sf_small).collect()}
    roots = brute_components([(r.doc_id, r.text) for r in seen.values()], 5, 4, 5)
    assert near == set(roots.values())

    out = stages["pii"](spark, docs, sf_small)
    assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in out.collect())
    assert not out.filter("text rlike '[a-z0-9]@[a-z0-9]+[.]'").count()


def test_run(spark, sf_small):
    out = corpus_pipeline.run(spark, sf_small).collect()
    ids = {r.doc_id for r in out}
    assert ids and ids <= {r.doc_id for r in read_table(spark, sf_small, "documents", "doc_id").collect()}
    used = {}
    for r in out:
        used[r.sequence_id] = max(used.get(r.sequence_id, 0), r.offset + r.length)
    assert max(used.values()) <= packing.CAPACITY
    assert len(used) <= sum(r.length for r in out) // packing.CAPACITY + 2


def test_run_on_empty_tables(spark, sf_small, tmp_path):
    for t in ("documents", "labels"):
        read_table(spark, sf_small, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in QUERIES.items():
        if name not in ("op4_html_extraction",):
            assert query(spark, str(tmp_path)).count() == 0, name
