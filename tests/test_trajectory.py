"""Detectors against direct definitions, and sanity of the estimators."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowrisk.operators import audits, evaluate
from flowrisk.operators import trajectory as J

SCHEMA = "actor string, t double, seq string, src string, dst string, action string"


def _walk(seed, n, actor="a", nodes=5):
    rng = random.Random(seed)
    return [(actor, float(i * 1000 + rng.randrange(900)), f"{i:05d}", f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}",
             rng.choice("xy")) for i in range(n)]


def _kl(window, base, alpha=1.0):
    if not base:
        return 0.0
    w, b = Counter(window), Counter(base)
    e = set(w) | set(b)
    tw, tb = len(window) + alpha * len(e), len(base) + alpha * len(e)
    return max(0.0, sum((w[k] + alpha) / tw * math.log(((w[k] + alpha) / tw) / ((b[k] + alpha) / tb)) for k in e))


@pytest.mark.parametrize("size,alpha,stride", [(8, 1.0, 1), (8, 0.5, 3), (8, 2.0, 20)])
def test_rolling_excess_is_the_direct_sum(spark, size, alpha, stride):
    data = _walk(1, 60) + _walk(2, 9, "b") + _walk(3, 7, "short")
    got = {(r.actor, r.end_position): r.score for r in
           J.rolling_excess(spark.createDataFrame(data, SCHEMA), size, alpha, stride, slice_seconds=7000).collect()}
    want = {}
    for actor in ("a", "b", "short"):
        edges = [r[3:] for r in data if r[0] == actor]
        for end in range(size, len(edges) + 1, stride):
            want[(actor, end)] = _kl(edges[end - size:end], edges[:end - size], alpha)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_excess_leaves_out_the_time_range(spark):
    data = _walk(4, 40)
    df = spark.createDataFrame(data, SCHEMA)
    w = J.last_windows(df, 10)
    edges = [r[3:] for r in data]
    assert J.excess_kl(df, w).first().excess == pytest.approx(_kl(edges[-10:], edges[:-10]))


def test_one_way_beats_loop_and_reversible_is_near_zero(spark):
    rng = random.Random(5)
    one_way = [("one", float(i), f"{i}", f"n{i}", f"n{i + 1}", "x") for i in range(60)]
    loop = [("loop", float(i), f"{i}", f"n{i % 3}", f"n{(i + 1) % 3}", "x") for i in range(60)]
    state, chain = 0, []
    for i in range(4000):
        step = rng.choice([-1, 1])
        nxt = min(4, max(0, state + step))
        chain.append(("rev", float(i), f"{i:05d}", f"n{state}", f"n{nxt}", "x"))
        state = nxt
    df = spark.createDataFrame(one_way + loop + chain, SCHEMA)
    kl = {r.actor: r.kl for r in J.kl_irreversibility(df).collect()}
    l1 = {r.actor: r.flux_l1 for r in J.flux_divergence(df).collect()}
    assert kl["rev"] < 0.01 < kl["one"] and kl["rev"] < kl["loop"]
    assert l1["rev"] < 0.1 and l1["loop"] == pytest.approx(2.0)
    nodes = {(r.actor, r.node): r.divergence for r in J.node_divergence(df).collect()}
    assert nodes[("one", "n0")] == pytest.approx(1 / 60) and nodes[("one", "n60")] == pytest.approx(-1 / 60)
    assert nodes[("loop", "n0")] == 0


def test_visits_reverse_and_truncate(spark):
    v = spark.createDataFrame([("a", float(t), str(t), s, "x") for t, s in enumerate("pqrq")], "actor string, t double, seq string, state string, action string")
    tr = J.from_state_visits(v)
    assert [(r.src, r.dst) for r in tr.orderBy("t").collect()] == [("p", "q"), ("q", "r"), ("r", "q")]
    assert [(r.src, r.dst) for r in J.reverse(tr).orderBy("t").collect()] == [("q", "r"), ("r", "q"), ("q", "p")]
    assert J.state_space(J.truncate(tr, 1)).count() == 2


def test_pseudonyms_match_hmac(spark):
    import hashlib
    import hmac
    df = spark.createDataFrame(_walk(6, 20), SCHEMA)
    salt = hashlib.sha256(b"7").hexdigest()[:32].encode()
    out = J.pseudonymize(df, 7)
    want = hmac.new(salt, b"a", hashlib.sha256).hexdigest()[:16]
    assert {r.actor for r in out.collect()} == {want}
    assert {r.action for r in out.collect()} == {"T001", "T002"}
    times = sorted(r.t for r in out.collect())
    assert all(abs(x - y[1]) <= 30 for x, y in zip(times, _walk(6, 20)))
    assert audits.leak_scan(out.withColumn("id", F.lit(1)), ["id"]).count() == 0


def test_alert_budget_and_campaigns(spark):
    alerts = spark.createDataFrame([("a", 10.0, 0.5), ("a", 20.0, 0.9), ("b", 30.0, 0.7), ("b", 30.0, 0.7), ("a", 90000.0, 0.1)],
                                   "actor string, window_time double, score double")
    kept = evaluate.alert_budget(alerts, 2)
    assert {(r.actor, r.window_time) for r in kept.collect()} == {("a", 20.0), ("b", 30.0), ("a", 90000.0)}
    camps = spark.createDataFrame([("a", 0.0, 20.0, "f"), ("a", 5.0, 15.0, "g"), ("c", 0.0, 1e6, "f")],
                                  "actor string, t_start double, t_end double, flavor string")
    found = evaluate.campaign_detection(camps, kept)
    assert {(r.actor, r.flavor): r.alert_time for r in found.collect()} == {("a", "f"): 20.0, ("a", "g"): None, ("c", "f"): None}
    assert {(r.flavor, r.total, r.tp) for r in evaluate.budget_eval(found).collect()} == {("f", 2, 1), ("g", 1, 0), ("ALL", 3, 1)}


def test_average_precision_with_ties(spark):
    rng = random.Random(8)
    data = [(round(rng.random(), 1), rng.randrange(2)) for _ in range(200)]
    ap, tp, n = 0.0, 0, 0
    pos = sum(y for _, y in data)
    for s in sorted({x for x, _ in data}, reverse=True):
        here = [y for x, y in data if x == s]
        tp, n = tp + sum(here), n + len(here)
        ap += sum(here) / pos * tp / n
    df = spark.createDataFrame([("k", *d) for d in data], "k string, s double, y int")
    assert audits.average_precision(df, ["k"], "s", "y").first().average_precision == pytest.approx(ap)


def test_ks_statistic(spark):
    rng = random.Random(9)
    a, b = [rng.gauss(0, 1) for _ in range(80)], [rng.gauss(0.8, 1) for _ in range(60)]
    want = max(abs(sum(x <= v for x in a) / 80 - sum(x <= v for x in b) / 60) for v in a + b)
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b], "v double, first boolean")
    r = audits.ks_two_sample(df, "v", F.col("first")).first()
    assert r.statistic == pytest.approx(want) and 0 < r.p_value < 0.01


def test_leakage_audit_tells_apart(spark):
    rng = random.Random(10)
    rows = []
    for i in range(400):
        y = int(i % 4 == 0)
        f = [float(rng.gauss(3 * y, 1)) for _ in audits.FEATURES]
        rows.append((i % 5 < 3, y, "f" if y else "benign", *f))
    cols = "train boolean, y int, flavor string, " + ", ".join(f"{c} double" for c in audits.FEATURES)
    out = {r.stratum: r for r in audits.leakage_audit(spark.createDataFrame(rows, cols), F.col("train"), 40, 20).collect()}
    assert out["f"].status == "EXCEEDS_NO_SKILL" and out["ALL"].average_precision > 0.9
    assert out["ALL"].ci_lower <= out["ALL"].average_precision <= out["ALL"].ci_upper + 1e-9


def test_rolling_excess_at_every_end_and_over_chunks(spark):
    rng = random.Random(12)
    rows = [("a", float(i), f"{i:05d}", f"n{rng.randrange(4)}", f"n{rng.randrange(4)}", f"x{rng.randrange(2)}") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    edges = [r[3:] for r in rows]
    whole = {r.end_position: r.score for r in J.rolling_excess(df).collect()}
    small = {r.end_position: r.score for r in J.rolling_excess(df, chunk=50).collect()}
    assert whole.keys() == small.keys() == set(range(80, 401))
    for end in range(80, 401):
        inside, before = edges[end - 80:end], edges[:end - 80]
        support = set(inside) | set(before)
        w = {e: inside.count(e) + 1 for e in support}
        b = {e: before.count(e) + 1 for e in support}
        tw, tb = sum(w.values()), sum(b.values())
        want = max(0.0, sum(w[e] / tw * math.log(w[e] / tw / (b[e] / tb)) for e in support)) if before else 0.0
        assert whole[end] == pytest.approx(want, abs=1e-9) and small[end] == pytest.approx(want, abs=1e-9)


def test_every_action_has_its_own_token(spark):
    df = spark.createDataFrame([("a", float(i), str(i), "p", "q", f"act{i}") for i in range(1200)] + [("a", 1e6, "z", "p", "q", None)], SCHEMA)
    tokens = [r.action for r in J.pseudonymize(df, 7).collect()]
    assert len(tokens) == 1201 and len(set(tokens)) == 1201


def test_bootstrap_against_plain_resampling(spark):
    """The same draws, row by row; parts, blocks and a heavy score change nothing."""
    import hashlib

    import numpy as np
    rng = np.random.default_rng(9)
    rows = [("a" if i % 3 else None, float(rng.integers(0, 40)) / 8, int(rng.random() < 0.3)) for i in range(900)] + [("a", 1.0, 1)] * 150
    reps, prime = 30, (1 << 31) - 1
    want = {}
    for key in ("a", None):
        counts, found = {}, []
        for k, s, y in rows:
            if k == key:
                counts[s, y] = counts.get((s, y), 0) + 1
        for r in range(1, reps + 1):
            drawn = {}
            for (s, y), n in counts.items():
                for c in range(-(-n // 64)):
                    m = min(64, n - 64 * c)
                    h = hashlib.md5(f"42|{key or ''}|{round(s * 1e9)}|{y}|{c}".encode()).hexdigest()
                    d = [int(h[8 * i:8 * i + 8], 16) % prime for i in range(3)]
                    u = (d[0] * r * r + d[1] * r + d[2]) % prime / prime
                    drawn.setdefault(s, [0, 0])
                    k = sum(x <= u for x in audits.poisson_steps(m))
                    drawn[s][0] += k
                    drawn[s][1] += k * y
            n = p = ap = 0
            for s in sorted(drawn, reverse=True):
                n, p = n + drawn[s][0], p + drawn[s][1]
                ap += p / n * drawn[s][1] if n else 0
            found.append(ap / p)
        want[key] = tuple(np.percentile(found, [2.5, 97.5]))
    df = spark.createDataFrame(rows, "k string, s double, y int")
    got = {r.k: (r.ci_lower, r.ci_upper) for r in audits.bootstrap_intervals(df, ["k"], "s", "y", reps).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    before = audits.PART_ROWS, audits.DRAW_ROWS
    try:
        audits.PART_ROWS, audits.DRAW_ROWS = 7, 3
        again = {r.k: (r.ci_lower, r.ci_upper) for r in audits.bootstrap_intervals(df, ["k"], "s", "y", reps).collect()}
    finally:
        audits.PART_ROWS, audits.DRAW_ROWS = before
    assert again == {k: pytest.approx(v) for k, v in want.items()}


def test_poisson_steps_sum_to_one():
    for rows in (1, 7, 64):
        steps = audits.poisson_steps(rows)
        assert steps == sorted(steps) and steps[-1] == pytest.approx(1, abs=1e-12)


def test_few_rows_an_actor_are_not_sliced(spark):
    """A lookup of the state before each slice would be as large as the table; actors of few rows need none."""
    visits = spark.createDataFrame([(f"a{i % 3}" if i % 4 else None, i * 90000.0, i, f"s{i % 5}", "x") for i in range(40)],
                                   "actor string, t double, seq long, state string, action string")
    moved = J.from_state_visits(visits)
    placed = J.positions(moved)
    for df in (moved, placed):
        assert "Join " not in df._jdf.queryExecution().optimizedPlan().toString()
    assert moved.count() == 40 - 4 and placed.groupBy("actor").max("position").count() == 4
