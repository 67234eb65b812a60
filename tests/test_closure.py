"""Watches, closings and signals against a row-at-a-time model."""

import math
import random
from datetime import timedelta

import pytest
from shared import T0
from pyspark.sql import functions as F

from flowrisk.config import ClosureConfig, WorldConfig
from flowrisk.operators import closure as K

CFG = ClosureConfig()
ACTIONS = [("IAM_CREATE_KEY", "IDENTITY"), ("IAM_DELETE_KEY", "IDENTITY"), ("IAM_IMPERSONATE", "IDENTITY"),
           ("IAM_SET_POLICY", "CONTROL"), ("GCS_READ", "DATA"), ("COMPUTE_METADATA_CHANGE", "COMPUTE")]


def _random_events(seed, n=120, minutes=60 * 24 * 40):
    rng = random.Random(seed)
    out = []
    for at in sorted(rng.sample(range(minutes), n)):
        action, zone = rng.choice(ACTIONS)
        out.append((at, f"u{rng.randrange(3)}", action, zone, f"t{rng.randrange(14)}"))
    return out


def _model(events, point_in_time):
    """Direct reading of the rules: for each (window, actor), look at every watch."""
    floor = lambda m: m - m % 15
    watch = {}
    for at, actor, action, zone, target in events:
        opens = action in CFG.opening_types or zone in CFG.failsafe_zones
        if opens and target not in watch:
            kind = CFG.resource_types.get(action, "UNKNOWN")
            if action == "IAM_CREATE_KEY":
                expected, hours = "IAM_DELETE_KEY", 720
            elif action in CFG.temporal_ttl:
                expected, hours = "TEMPORAL_EXPIRY", CFG.temporal_ttl[action]
            else:
                expected, hours = "SETTLEMENT", CFG.settlement_hours.get(kind, 24)
            watch[target] = dict(o=at, actor=actor, kind=kind, e=expected, h=hours, closed=None, settled=None)
        elif target in watch and action == watch[target]["e"] and watch[target]["closed"] is None:
            watch[target]["closed"] = at
    out = {}
    for w, actor in sorted({(floor(e[0]), e[1]) for e in events}):
        mine = {t: x for t, x in watch.items() if x["actor"] == actor and (x["o"] <= w or not point_in_time)}
        closed, orphaned = 0, 0.0
        for t, x in mine.items():
            done = x["settled"] is not None
            if x["closed"] is not None and (x["closed"] <= w or not point_in_time):
                done = True
            if x["e"] == "TEMPORAL_EXPIRY" and x["o"] + x["h"] * 60 <= w:
                done = True
            if not done and x["kind"] not in CFG.never_settle:
                s = CFG.settlement_hours.get(x["kind"], 4) * 60
                last = max([x["o"]] + [e[0] for e in events if e[4] == t and x["o"] < e[0] <= w])
                if w - last >= s:
                    x["settled"] = w
                    done = True
            closed += done
            if not done and w - x["o"] > x["h"] * 60:
                orphaned += CFG.sensitivity[x["kind"]] * (1 + math.log2((w - x["o"]) / (x["h"] * 60)))
        out[(w, actor)] = (len(mine), closed, orphaned)
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("point_in_time", [True, False])
def test_signals_match_model(spark, make_events, seed, point_in_time):
    events = _random_events(seed)
    ev = make_events(events)
    pairs = K.seed_pairs(spark)
    keys = ev.select("window_start", "actor_id").distinct()
    closed = K.close_times(ev, K.watches(ev, pairs), keys, pairs)
    got = {((r.window_start - T0).total_seconds() / 60, r.actor_id): r
           for r in K.closure_signals(closed, keys, WorldConfig(), point_in_time).collect()}
    want = _model(events, point_in_time)
    assert set(got) == set(want)
    for k, (total, done, orphaned) in want.items():
        r = got[k]
        assert (r.total_watches, r.closed_watches) == (total, done), k
        assert r.orphaned_privilege == pytest.approx(orphaned, abs=1e-9)
        assert r.closure_ratio == pytest.approx(done / total if total else 1.0)


def test_never_reopened_and_unknown_opening(spark, make_events):
    ev = make_events([(0, "a", "IAM_DELETE_KEY", "IDENTITY", "t"), (5, "a", "IAM_CREATE_KEY", "IDENTITY", "t")])
    w = K.watches(ev, K.seed_pairs(spark)).collect()
    assert len(w) == 1 and w[0].resource_type == "UNKNOWN" and w[0].expected_close_type == "SETTLEMENT"
    assert w[0].window_hours == 4 and w[0].sensitivity == 3.0


def test_discovered_pair_closes_settlement_watch(spark, make_events):
    ev = make_events([(0, "a", "IAM_SET_POLICY", "CONTROL", "t"), (5, "a", "GCS_READ", "DATA", "t")])
    seeded = K.seed_pairs(spark)
    grown = seeded.unionByName(spark.createDataFrame(
        [("disc", "IAM_SET_POLICY", "GCS_READ", 2, 2)], seeded.schema))
    opened = K.watches(ev, seeded)
    assert K.explicit_closings(ev, opened, seeded).count() == 0
    assert K.explicit_closings(ev, opened, grown).count() == 1


def test_mining_counts_each_event_once(spark, make_events):
    ev = make_events([(0, "a", "IAM_CREATE_KEY", "IDENTITY", "t"), (10, "a", "IAM_CREATE_KEY", "IDENTITY", "t"),
                      (60, "a", "IAM_DELETE_KEY", "IDENTITY", "t"), (90, "a", "IAM_CREATE_KEY", "IDENTITY", "t"),
                      (180, "a", "IAM_DELETE_KEY", "IDENTITY", "t"), (181, "a", "GCS_READ", "DATA", "t")])
    got = {r.candidate_id: r for r in K.mine_pairs(ev).collect()}
    c = got["cp-IAM_CREATE_KEY-IAM_DELETE_KEY"]
    assert c.obs_count == 3 and c.median_gap_hours == pytest.approx(1.0)
    assert K.promote_pairs(K.mine_pairs(ev), K.seed_pairs(spark)).count() == 0
