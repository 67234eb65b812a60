import math
import random
from datetime import timedelta

import pytest
from shared import T0, rows
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.functions import expressions as X
from flowrisk.operators import evaluate, invariants, provenance, scoring
from flowrisk.operators import world as W
from flowrisk.plans import pipeline, tables
from flowrisk.operators import closure


def _lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


@pytest.mark.parametrize("chunk", [3, 7, 4096])
def test_zone_match_in_chunks(spark, chunk):
    rng = random.Random(chunk)
    zones = C.ZONES
    seqs = {f"a{i}": [rng.choice(zones) for _ in range(rng.randrange(1, 40))] for i in range(25)}
    pats = {f"p{i}": [rng.choice(zones) for _ in range(rng.randrange(1, 9))] for i in range(5)}
    sdf = spark.createDataFrame([(T0, a, p + 1, z) for a, s in seqs.items() for p, z in enumerate(s)],
                                "window_start timestamp, actor_id string, position long, target_zone string")
    pdf = spark.createDataFrame(list(pats.items()), "pattern_id string, expected_zones array<string>")
    for r in provenance.zone_match(sdf, pdf, chunk).collect():
        s, p = seqs[r.actor_id], pats[r.pattern_id]
        assert r.zone_score == pytest.approx(_lcs(s, p) / max(len(s), len(p)))


def _flags(make_events, spark, events, known=()):
    ev = make_events(events)
    t = W.target_activity(ev)
    a = W.window_activity(t)
    e = W.edge_novelty(W.zone_edges(ev))
    k = spark.createDataFrame([(x,) for x in known], "actor_id string")
    return ev, a, t, e, invariants.check_invariants(a, t, e, k)


@pytest.mark.parametrize("action,zone,fired", [
    ("IAM_SET_POLICY", "CONTROL", ["INV_001"]), ("IAM_CREATE_KEY", "IDENTITY", ["INV_002", "INV_003"]),
    ("IAM_IMPERSONATE", "IDENTITY", ["INV_004", "INV_005"]), ("SECRET_ACCESS", "SECRET", ["INV_006"]),
    ("KMS_DECRYPT", "SECRET", ["INV_008"]), ("COMPUTE_METADATA_CHANGE", "COMPUTE", ["INV_009"]),
    ("GCS_READ", "DATA", [])])
def test_single_event_rules(make_events, spark, action, zone, fired):
    *_, flags = _flags(make_events, spark, [(0, "a", action, zone, "t")])
    r = flags.first()
    assert r.fired_invariants == fired and r.inv_count == len(fired)
    assert r.inv_score == max([C.INVARIANT_SEVERITY[f] for f in fired], default=0)


def test_history_rules_and_explanations(make_events, spark):
    sa = "svc@p.iam.gserviceaccount.com"
    past = [(i * 15, sa, "GCS_READ", "DATA", "t", {"delegation_chain": ["d"]}) for i in range(10)]
    ev, a, t, e, flags = _flags(make_events, spark, past + [(300, sa, "IAM_SET_POLICY", "CONTROL", "t"),
                                                            (301, sa, "SECRET_ACCESS", "SECRET", "s")])
    last = flags.orderBy(F.desc("window_start")).first()
    assert last.fired_invariants == ["INV_001", "INV_006", "INV_007", "INV_010", "INV_011"]
    text = invariants.explain(ev, flags, a, e, t).orderBy(F.desc("window_start")).first().explanation
    assert "svc@p.iam.gserviceaccount.com acted 2 times without delegation, which it had 10 times in 10 before (100%)" in text
    assert "went from CONTROL to SECRET for the first time" in text


def test_known_actor_and_deploy(make_events, spark):
    *_, flags = _flags(make_events, spark, [(0, "a", "IAM_CREATE_KEY", "IDENTITY", "t"),
                                            (1, "a", "IAM_SET_POLICY", "CONTROL", "p", {"is_deploy": True})], ["a"])
    assert flags.first().fired_invariants == ["INV_002"]


@pytest.mark.parametrize("chunk", [7, 4096])
def test_patterns_of_any_length(spark, chunk):
    rng = random.Random(5)
    pats = [[rng.choice("ABCDE") for _ in range(n)] for n in (60, 61, 100)]
    seq = [rng.choice("ABCDEF") for _ in range(40)]
    sdf = spark.createDataFrame([(T0, "a", i + 1, z) for i, z in enumerate(seq)], "window_start timestamp, actor_id string, position long, target_zone string")
    pdf = spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(pats)], "pattern_id string, expected_zones array<string>")
    got = {r.pattern_id: r.zone_score for r in provenance.zone_match(sdf, pdf, chunk).collect()}
    assert got == pytest.approx({f"p{i}": _lcs(seq, p) / max(len(seq), len(p)) for i, p in enumerate(pats)})


@pytest.mark.parametrize("actor,expected,score", [
    ("a@x", [], 1.0), ("a@x", ["a@x"], 1.0), ("a@x", ["a@y", "a@x"], 0.8), ("a@x", ["", "b@x"], 0.0), ("a", ["a@z"], 0.8)])
def test_actor_match(spark, actor, expected, score):
    df = spark.createDataFrame([(actor, expected)], "a string, e array<string>")
    assert df.select(provenance.actor_match(F.col("a"), F.col("e"))).first()[0] == score


@pytest.mark.parametrize("level,resolved,mult", [("STRONG", False, 1.0), ("WEAK", False, 0.6), ("WEAK", True, 0.8), ("NONE", True, 0.0)])
def test_residual_formula(spark, level, resolved, mult):
    key = (T0, "a")
    s = spark.createDataFrame([(*key, 0.9)], "window_start timestamp, actor_id string, fusion_raw double")
    m = spark.createDataFrame([(*key, 0.7, "p")], "window_start timestamp, actor_id string, pattern_match_score double, matched_pattern_id string")
    p = spark.createDataFrame([(*key, level, "r")], "window_start timestamp, actor_id string, provenance_level string, trigger_ref string")
    c = spark.createDataFrame([("r", resolved)], "trigger_ref string, resolved boolean")
    assert provenance.residual_risk(s, m, p, c).first().residual_risk == pytest.approx(0.9 * (1 - 0.3 * 0.7 * mult))


def test_trigger_chains(spark):
    ev = spark.createDataFrame([("projects/p/locations/l/jobs/j",)] * 2 + [("projects/p/locations/l/jobs/forged",), ("sched:j:1",), ("odd",),
                                ("projects/p/locations//jobs/",)], "trigger_ref string")
    none = spark.createDataFrame([("x@y",)], "actor_id string")
    sched = spark.createDataFrame([("service-1@gcp-sa-cloudscheduler.iam.gserviceaccount.com",)], "actor_id string")
    got = {r.trigger_ref: r.resolved for r in provenance.trigger_chains(ev, ev, none).collect()}
    assert [k for k, v in got.items() if v] == ["projects/p/locations/l/jobs/j"]
    assert {r.trigger_ref: r.resolved for r in provenance.trigger_chains(ev, ev, sched).collect()}["sched:j:1"]


@pytest.mark.parametrize("energy_in,level", [((1.0, 1.0, 0.0), "ALERT_HIGH"), ((0.8, 1.0, 0.0), "ALERT_MED"), ((0.3, 1.0, 0.0), "NORMAL"),
                                             ((0.4, 0.0, 0.0), "ALERT_MED"), ((0.0, 1.0, 31.0), "WATCH")])
def test_energy_levels(spark, energy_in, level):
    df = spark.createDataFrame([energy_in], "residual_risk double, closure_ratio double, orphaned_privilege double")
    assert scoring.risk_energy(df).first().alert_level == level


def test_weights_sum_and_reweight():
    assert sum(C.FUSION_WEIGHTS.values()) == pytest.approx(1.0)
    for mode in ("zero", "redistribute"):
        w = evaluate.reweight(C.FUSION_WEIGHTS, ["closure_gap"], mode)
        assert w["closure_gap"] == 0 and sum(w.values()) == pytest.approx(1.0)


def test_ablated_score_on_a_bound_keeps_its_tier(spark):
    """0.68 of 0.85 is exactly HIGH; seven of the eight signals stay."""
    row = dict.fromkeys(["inv_score", "inv_count", "novelty_score", "bridge_new", "delta_f", "orphaned_privilege", "burst_per_min", "breadth_entropy"], 0.0) | {
        "actor_id": "u1", "inv_score": 5.0, "novelty_score": 10.0, "sigma_coarse": 100.0, "bridge_new": 5.0, "inv_count": 4.0 / 13 * 10, "closure_ratio": 1.0, "fusion_raw": 0.68}
    rows = []
    for n in range(0, 11):
        for d in (0.0, 1.0, 2.5, 5.0):
            for v in range(0, 21):
                rows.append(row | {"inv_count": float(n), "delta_f": d, "novelty_score": v / 2})
    got = evaluate.ablate(spark.createDataFrame(rows), ["closure_gap", "orphaned_priv"], "zero").collect()
    both = evaluate.ablate(spark.createDataFrame(rows), ["closure_gap", "orphaned_priv"], "redistribute").collect()
    for r, s in zip(got, both):
        want = (.17 * 1.0 + .13 * (r.inv_count / 10) + .30 * (r.novelty_score / 10) + .04 * (1 / (1 + math.exp(-97.0))) + .13 * 1.0 + .08 * (r.delta_f / 5)) / .85
        assert r.ablated == want == s.ablated
    assert [r.new_tier for r in got] == ["HIGH" if r.ablated >= .8 else "MEDIUM" if r.ablated >= .5 else "WATCH" for r in got]


def test_numbers_in_sentences_round_as_sql_does(spark):
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.5, 0.95, 1.0, 1.15, 1.25, 1.35, 1.45, 1.75, 1.95, 2.5, 82.5, 92.5, 99.95, 87.49999999999999, 1e-9, 0.0005, 0.125, 1.005, 123456789.125, -1.25, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(*[X.fixed(F.col("v"), d).alias(str(d)) for d in range(4)]).collect()
    assert [[r[str(d)].lstrip("-") for d in range(4)] for r in got] == [[f"{abs(v):.{d}f}" for d in range(4)] for v in values]


def test_sigmoid_and_clip(spark):
    r = spark.range(1).select(X.sigmoid(F.lit(3.0)), X.sigmoid(F.lit(-1e6)), X.clip_unit(F.lit(7.0), 5.0),
                              X.clip_unit(F.lit(-1.0), 5.0), X.clip_unit(F.lit(1.0), 0)).first()
    assert r[0] == 0.5 and 0 <= r[1] < 1e-200 and list(r)[2:] == [1.0, 0.0, 0.0]


def test_attack_scores_above_benign(spark, make_events):
    benign = [(d * 1440 + i, "w", "GCS_READ", "DATA", "b", {"trigger_ref": "projects/p/locations/l/jobs/j", "provenance_level": "WEAK"})
              for d in range(4) for i in (0, 3, 6)]
    attack = [(4 * 1440, "x", "IAM_CREATE_KEY", "IDENTITY", "k"), (4 * 1440 + 2, "x", "SECRET_ACCESS", "SECRET", "s"),
              (4 * 1440 + 4, "x", "GCS_WRITE", "EXFIL_RISK", "o")]
    known = spark.createDataFrame([("w",)], "actor_id string")
    risk = pipeline.score_events(make_events(benign + attack), known, tables.patterns(spark), closure.seed_pairs(spark), explain=True)
    by = {r.actor_id: r.m for r in risk.groupBy("actor_id").agg(F.max("residual_risk").alias("m")).collect()}
    assert by["x"] >= 2 * by["w"]
    assert "a service-account key was issued for k" in risk.where("actor_id = 'x'").first().explanation


def test_pattern_registry_and_usage(spark):
    p = tables.patterns(spark)
    off = provenance.deactivate_pattern(p, "pat-a")
    assert {r.pattern_id for r in provenance.active_patterns(off).collect()} == {"pat-b", "pat-c"}
    more = provenance.register_pattern(off, p.where("pattern_id = 'pat-b'").unionByName(
        p.where("pattern_id = 'pat-c'").withColumn("pattern_id", F.lit("pat-d"))))
    assert sorted(r.pattern_id for r in more.collect()) == ["pat-a", "pat-b", "pat-c", "pat-d"]
    m = spark.createDataFrame([(T0, "a", "pat-b"), (T0, "b", "pat-b"), (T0.replace(hour=11), "a", "pat-b"), (T0, "c", None)],
                              "window_start timestamp, actor_id string, matched_pattern_id string")
    r = provenance.pattern_usage(m).first()
    assert (r.match_count, r.last_matched_ts) == (2, T0.replace(hour=11))


def test_newest_pattern_wins_ties(spark):
    w = spark.createDataFrame([(T0, "a", 1)], "window_start timestamp, actor_id string, event_count long")
    s = spark.createDataFrame([(T0, "a", 1, "DATA")], "window_start timestamp, actor_id string, position long, target_zone string")
    base = tables.patterns(spark).where("pattern_id = 'pat-c'").withColumn("expected_window", F.lit(None).cast(
        "struct<days_of_week:array<int>,hour_start:int,hour_end:int>"))
    both = base.unionByName(base.withColumn("pattern_id", F.lit("pat-0"))
                            .withColumn("registered_ts", F.to_timestamp(F.lit("2025-01-01"))))
    assert provenance.pattern_match(w, s, both).first().matched_pattern_id == "pat-0"


@pytest.mark.parametrize("chunk", [3, 4096])
def test_pattern_match_groups_no_pairs(spark, chunk):
    """Short, long and empty patterns against a window in one chunk, in several, and without a sequence; windows and patterns are not multiplied."""
    w = spark.createDataFrame([(T0, a, 5) for a in "abc"], "window_start timestamp, actor_id string, event_count long")
    seqs = {"a": ["DATA", "SECRET"], "b": ["DATA", "SECRET", "DATA", "COMPUTE", "SECRET"]}
    s = spark.createDataFrame([(T0, a, i + 1, z) for a, q in seqs.items() for i, z in enumerate(q)],
                              "window_start timestamp, actor_id string, position long, target_zone string")
    pats = {"p1": ["SECRET", "COMPUTE"], "p2": ["DATA", "SECRET"] * 40, "p3": []}
    p = tables.patterns(spark).where("pattern_id = 'pat-a'").drop("pattern_id", "expected_zones", "registered_ts", "expected_actors").join(
        spark.createDataFrame([(k, z, ["a"] if k == "p3" else [], T0) for k, z in pats.items()],
                              "pattern_id string, expected_zones array<string>, expected_actors array<string>, registered_ts timestamp"))
    got = provenance.pattern_match(w, s, p, chunk)
    best = {r.actor_id: (r.pattern_match_score, r.matched_pattern_id) for r in got.collect()}
    for actor in "abc":
        score = {k: 0.3 * (actor == "a" or k != "p3") + 0.35 * (
            _lcs(seqs[actor], z) / max(len(seqs[actor]), len(z)) if z and actor in seqs else 1.0) + 0.35 for k, z in pats.items()}
        top = max(score, key=lambda k: (round(score[k], 9), k))
        assert best[actor] == (pytest.approx(score[top]), top)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "max(struct" not in plan


def test_patterns_are_not_paired_chunk_file_by_chunk_file(spark):
    """Patterns are sent to the chunks: a Cartesian product reads all chunks once per partition of the patterns."""
    at = [(T0, "a", i + 1, z) for i, z in enumerate(["DATA", "SECRET", "DATA"])]
    sequences = spark.createDataFrame(at, "window_start timestamp, actor_id string, position long, target_zone string")
    patterns = spark.createDataFrame([("p", ["DATA", "SECRET"])], "pattern_id string, expected_zones array<string>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = provenance.zone_match(sequences, patterns)
        assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
        assert [(r.pattern_id, r.zone_score) for r in out.collect()] == [("p", pytest.approx(2 / 3))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("most", [0, 3, 4096])
def test_rows_of_calm_windows_and_busy_ones_agree(spark, most):
    """Edges, provenance and matches do not depend on which windows become a row; totals of edges give novelty and flux of the single ones."""
    events = tables.canonical_events(spark, "/root/testdata/sf0.001", tables.DAY)
    busy = [(T0 + timedelta(minutes=i), f"b{i:03d}", "bu" if i % 3 else None, z, f"t{i % 4}", None if i % 5 else f"r{i}", "NONE" if i % 5 else "STRONG")
            for i, z in enumerate((C.ZONES * 4 + [None])[:25])]
    busy = spark.createDataFrame(busy, "ts timestamp, event_id string, actor_id string, target_zone string, target_id string, trigger_ref string, provenance_level string")
    events = events.unionByName(busy.withColumn("window_start", F.to_timestamp(F.lit("2024-01-10"))).withColumn("action_type", F.lit("GCS_READ")), allowMissingColumns=True)
    model = pipeline.build_world(events, closure.seed_pairs(spark), tables.DAY, most=most)
    assert (model.busy is None) == (most == 4096)
    single = W.edge_novelty(W.zone_edges(events, tables.DAY), tables.DAY)
    per = single.groupBy(*W.WINDOW_KEY, "source_zone", "target_zone", "is_new").agg(F.sum("edge_count").alias("edge_count"), F.count("*").alias("n_targets"))
    assert sorted(rows(model.edges.select(per.columns))) == sorted(rows(per))
    assert sorted(rows(W.novelty_scores(model.edges))) == sorted(rows(W.novelty_scores(single)))
    fused = model.activity.select(*W.WINDOW_KEY, F.lit(1.0).alias("fusion_raw"))
    known = tables.known_initiators(spark, "/root/testdata/sf0.001")
    names = ["window_start", "actor_id", "provenance_level", "pattern_match_score", "matched_pattern_id", "trigger_chain_resolved", "residual_risk"]
    got = pipeline.residual(model, fused, known, tables.patterns(spark)).select(names)
    own = provenance.dominant_provenance(events)
    matches = provenance.pattern_match(model.activity, W.zone_sequences(events, tables.DAY), tables.patterns(spark))
    want = provenance.residual_risk(fused, matches, own, provenance.trigger_chains(own, events, known)).select(names)
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))
