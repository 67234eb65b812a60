import random
from datetime import timedelta

import pandas as pd
import pytest
from shared import T0

from flowrisk.config import CorrelationConfig
from flowrisk.operators import correlate as K

RUN = "project_id string, job_id string, target_url string, attempt_type string, scheduled_time timestamp, insert_id string"
CALL = "project_id string, service_name string, request_url string, timestamp timestamp, insert_id string, is_scheduler_invoked boolean"


def _at(s):
    return T0 + timedelta(seconds=s)


def _greedy(runs, calls, tol=60):
    used, out = set(), {}
    for s in sorted(runs, key=lambda r: (r[1], r[0])):
        near = sorted((c[1] - s[1], c[0], c[2] == s[2]) for c in calls if c[0] not in used and 0 <= c[1] - s[1] < tol)
        pick = next((n for n in near if n[2]), near[0] if near else None)
        if pick:
            used.add(pick[1])
            out[s[0]] = (pick[1], pick[2])
    return out


@pytest.mark.parametrize("seed,span", [(1, 2000), (2, 300), (3, 120)])
def test_links_match_one_pass_even_when_dense(spark, seed, span):
    """The denser the logs, the more a choice in one slice depends on slices before it."""
    rng = random.Random(seed)
    runs = [(f"r{i:03d}", rng.randrange(span), f"u{rng.randrange(3)}") for i in range(90)]
    calls = [(f"c{i:03d}", rng.randrange(span + 60), f"u{rng.randrange(3)}") for i in range(80)]
    rdf = spark.createDataFrame([("p", "j", u + "/", "AttemptStarted", _at(t), i) for i, t, u in runs], RUN)
    cdf = spark.createDataFrame([("p", "s", u, _at(t), i, True) for i, t, u in calls], CALL)
    links = K.link_requests(rdf, cdf, CorrelationConfig(slice_seconds=60))
    got = {r.scheduler_id: (r.request_id, r.url_match) for r in links.collect()}
    assert got == _greedy(runs, calls)


def _happy(spark, audit_at=5, call_at=3, actor="w", invoked=True):
    runs = spark.createDataFrame([("p", "job", "https://s/", "AttemptStarted", _at(0), "r1"),
                                  ("p", "job", "https://s/", "AttemptStarted", _at(600), "r2")], RUN)
    calls = spark.createDataFrame([("p", "svc", "https://s", _at(call_at), "c1", invoked)], CALL)
    audit = spark.createDataFrame([("e1", _at(audit_at), actor)], "event_id string, ts timestamp, actor_id string")
    smap = spark.createDataFrame([("svc", "w")], "service_name string, worker string")
    links = K.link_requests(runs, calls)
    return K.correlate_events(audit, links, calls, runs, smap).first()


def test_happy_path(spark):
    r = _happy(spark)
    assert r.trigger_ref == f"sched:job:{int(pd.Timestamp(T0, tz='UTC').timestamp())}"
    assert r.correlation_confidence == round(0.4 + 0.3 + 0.2 + 0.1 * (1 - 2 / 600), 4)


@pytest.mark.parametrize("case", [dict(audit_at=2), dict(audit_at=123), dict(actor="x"), dict(invoked=False), dict(call_at=60)])
def test_no_match(spark, case):
    if case.get("call_at") == 60:
        case["audit_at"] = 61
    r = _happy(spark, **case)
    assert r.trigger_ref is None and r.correlation_confidence == 0.0


def test_map_validation(spark):
    links = spark.createDataFrame([("svc", _at(0)), ("new", _at(1000))], "service_name string, request_ts timestamp")
    audit = spark.createDataFrame([("w", _at(0)), ("w", _at(120)), ("x", _at(5)), ("n", _at(1001)), ("w", _at(121))], "actor_id string, ts timestamp")
    smap = spark.createDataFrame([("svc", "w"), ("gone", "g")], "service_name string, worker string")
    v = K.validate_service_map(links, audit, smap)
    assert {(r.service_name, r.status, r.n_events) for r in v.collect()} == {("svc", "confirmed", 2), ("new", "discovered", 1), ("gone", "unobserved", 0)}
    assert K.hydration_summary(v).first().hydration_complete is False
