"""Property tests: operators against straight-line Python implementations."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetscope.operators import checks as ck
from fleetscope.operators.graph import blocking_chains, dependency_levels

SETTINGS = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
BASE = dt.datetime(2024, 1, 1)


def _py_match(value, threshold, variance=1):
    if value is None:
        return False
    cmp = next((c for c in ("<=", ">=", "<>", "<", ">", "=") if threshold.startswith(c)), None)
    if cmp is None:
        return False  # a bare number never matches
    try:
        tv = Decimal(threshold.replace(cmp, "")).quantize(Decimal("0.00001"), ROUND_HALF_UP)
    except Exception:  # noqa: BLE001
        return False
    v = Decimal(repr(value)).quantize(Decimal("0.00001"), ROUND_HALF_UP)
    up, down = Decimal(1) + Decimal(variance) / 100, Decimal(1) - Decimal(variance) / 100
    return {"<=": v <= tv * down, ">=": v >= tv * up, "<>": v != tv, "<": v < tv * down,
            ">": v > tv * up, "=": v == tv}[cmp]


thresholds = st.builds(lambda c, n: f"{c}{n}", st.sampled_from(["<", ">", "<=", ">=", "=", "<>", ""]),
                       st.decimals(min_value=-1000, max_value=1000, places=2, allow_nan=False))
values = st.one_of(st.none(), st.floats(min_value=-1100, max_value=1100, allow_nan=False).map(lambda x: round(x, 3)))


@SETTINGS
@given(st.lists(st.tuples(values, thresholds), min_size=1, max_size=30))
def test_threshold_match_equals_decimal_reference(spark, cases):
    df = spark.createDataFrame(cases, "v double, t string")
    got = [r.m for r in df.select(ck.threshold_match("v", "t").alias("m")).collect()]
    want = [_py_match(v, t) for v, t in cases]
    assert got == want


statuses = st.lists(st.sampled_from(["OK", "WARNING", "CRITICAL"]), min_size=1, max_size=25)


def _runs(seq):
    runs, start = [], 0
    for i in range(1, len(seq) + 1):
        if i == len(seq) or seq[i] != seq[i - 1]:
            runs.append((seq[start], start, i - 1, i - 1 - start))
            start = i
    return runs


@SETTINGS
@given(statuses)
def test_status_runs_equal_brute_force(spark, seq):
    data = [("s", 1, BASE + dt.timedelta(hours=7 * i), float(i), st_) for i, st_ in enumerate(seq)]
    h = spark.createDataFrame(data, "sql_instance string, check_id int, snapshot_time timestamp_ntz, "
                                    "check_value double, check_status string")
    ch = ck.status_change(h)
    got = sorted((r.check_status, r.status_start_time, r.status_end_time, r.check_count)
                 for r in ck.status_runs(ch).collect())
    want = sorted((s, data[a][2], data[b][2], n) for s, a, b, n in _runs(seq))
    assert got == want
    ref = sorted((r.check_status, r.status_start_time, r.check_count)
                 for r in ck.status_runs(ch, mode="reference", now=BASE).collect())
    changes = [i for i in range(len(seq)) if i == 0 or seq[i] != seq[i - 1]]
    unchanged = [i for i in range(len(seq)) if i > 0 and seq[i] == seq[i - 1]]
    want_ref = sorted((seq[i], data[i][2], sum(1 for j in unchanged if j > i)) for i in changes)
    assert ref == want_ref


dags = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=25)


@SETTINGS
@given(dags)
def test_dependency_levels_equal_longest_path(spark, pairs):
    # keep a DAG: edges go from a lower to a higher node number (child > parent)
    edges = sorted({(max(a, b), min(a, b)) for a, b in pairs if a != b})
    if not edges:
        return
    df = spark.createDataFrame([(f"n{c}", f"n{p}") for c, p in edges], "child string, parent string")
    got = {r.child: r.level for r in dependency_levels(df).collect()}
    nodes = {x for e in edges for x in e}
    level = {n: 1 for n in nodes}
    for n in sorted(nodes):
        for c, p in edges:
            if c == n:
                level[n] = max(level[n], level[p] + 1)
    assert got == {f"n{n}": lv for n, lv in level.items()}


forests = st.lists(st.integers(0, 30), min_size=1, max_size=30)


@SETTINGS
@given(forests)
def test_blocking_chains_equal_tree_walk(spark, parents):
    # node i+1 is blocked by parents[i] % (i+1): a forest rooted at 0 within one loop
    edges = [(1, BASE, i + 1, 0, parents[i] % (i + 1), 0) for i in range(len(parents))]
    df = spark.createDataFrame(edges, "monitor_loop long, event_time timestamp_ntz, blocked_spid int, "
                                      "blocked_ecid int, blocking_spid int, blocking_ecid int")
    got = {r.session_id: (r.blocking_level, r.blocking_chain) for r in blocking_chains(df).collect()}
    parent = {c: p for _, _, c, _, p, _ in edges}

    def chain(n):
        path = [n]
        while n in parent:
            n = parent[n]
            path.append(n)
        return path[::-1]

    want = {}
    for n in range(len(parents) + 1):
        c = chain(n)
        want[n] = (len(c) - 1, "/" + "".join(f"{x}.0/" for x in c))
    assert got == want


samples = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 12), st.integers(0, 60)),
                   min_size=1, max_size=30, unique_by=lambda t: (t[0], t[1]))


@SETTINGS
@given(samples)
def test_counter_delta_equals_previous_snapshot_walk(spark, rows):
    """Delta against the previous snapshot of the instance (not the key's previous row); resets give 0."""
    from fleetscope.operators.deltas import counter_delta

    data = [("s", k, 1, BASE + dt.timedelta(hours=h), v) for k, h, v in rows]
    df = spark.createDataFrame(data, "sql_instance string, instance_name string, snapshot_type_id int, "
                                     "snapshot_time timestamp_ntz, v bigint")
    got = {(r.instance_name, r.snapshot_time): (r.v_delta, r.delta_seconds)
           for r in counter_delta(df, ["sql_instance", "instance_name", "snapshot_type_id"], "snapshot_time",
                                  ["v"]).collect()}
    times = sorted({BASE + dt.timedelta(hours=h) for _, h, _ in rows})
    value = {(k, BASE + dt.timedelta(hours=h)): v for k, h, v in rows}
    want = {}
    for (k, t), v in value.items():
        i = times.index(t)
        prev_t = times[i - 1] if i > 0 else None
        pv = value.get((k, prev_t)) if prev_t is not None else None
        if pv is None:
            want[(k, t)] = (0, None)
        else:
            want[(k, t)] = (v - pv if v > pv else 0, int((t - prev_t).total_seconds()))
    assert got == want
