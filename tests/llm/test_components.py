"""Connected components: results, and no more steps, tasks or edges than the input needs."""

import random

import pytest
from pyspark.sql import functions as F

from fleetscope.llm import components as steps
from fleetscope.llm import ngram_join
from fleetscope.llm.components import components


def brute(edges):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {x: top(x) for x in root}


def random_edges():
    rnd = random.Random(3)
    return [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(49, 60), (60, 61), (7, 3)], random_edges()])
def test_components_against_brute_force(spark, edges):
    edges = [e for e in edges if e[0] != e[1]]
    rows = spark.createDataFrame(edges + edges[:5] + [(b, a) for a, b in edges[:5]] + [(1, 1)], "a long, b long")
    found = components(rows).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.label for r in found} == brute(edges)


def test_stars_need_no_steps(spark, monkeypatch):
    taken = []
    real = steps._stars
    monkeypatch.setattr(steps, "_stars", lambda *a: taken.append(a) or real(*a))
    star = spark.range(1, 400).select((F.col("id") % 2).alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.node: r.label for r in components(star).collect()} == {i: (i + 1) % 2 for i in range(2, 401)} | {0: 0, 1: 1}
    assert not taken
    assert components(star.limit(0)).count() == 0


def test_few_rows_take_few_tasks(spark, monkeypatch):
    """The shuffles of a small graph have 97 partitions here; its steps have a task a core."""
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    tasks = []
    real = steps.written
    monkeypatch.setattr(steps, "written", lambda df, name: tasks.append(df.rdd.getNumPartitions()) or real(df, name))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        path = spark.range(30).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert {r.label for r in components(path).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(tasks) > 2
    assert max(tasks) <= spark.sparkContext.defaultParallelism


def test_more_links_join_components_alone(spark, monkeypatch):
    seen = []
    real = ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda e: seen.append(sorted(map(tuple, e.collect()))) or real(e))
    label = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)], "node long, label long")
    labelled = spark.createDataFrame([(i, {2: 1, 3: 1, 6: 5}.get(i, i)) for i in range(1, 9)], "rep long, component long")
    links = spark.createDataFrame([(2, 3), (3, 6), (7, 6)], "a long, b long")
    out = ngram_join._tied(labelled, label, links, 8)
    assert dict(map(tuple, out.collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 1, 7: 1, 8: 8}
    assert seen == [[(1, 5), (7, 5)]]
    assert ngram_join._tied(labelled, label, links.filter("a = 2"), 8) is labelled
