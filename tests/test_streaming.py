import json
import os
from datetime import timedelta

import pytest
from shared import T0
from pyspark.sql import functions as F

from flowrisk.config import CorrelationConfig
from flowrisk.operators import closure
from flowrisk.operators import world as W
from flowrisk.plans import pipeline, tables
from flowrisk.sources import raw_logs
from flowrisk.streaming import live

METHODS = {"key": ("iam.googleapis.com", "CreateServiceAccountKey"), "drop": ("iam.googleapis.com", "DeleteServiceAccountKey"),
           "act": ("iamcredentials.googleapis.com", "GenerateAccessToken"), "get": ("storage.googleapis.com", "storage.objects.get"),
           "secret": ("secretmanager.googleapis.com", "AccessSecretVersion")}


def _line(minute, actor, kind, target, n):
    s, m = METHODS[kind]
    at = (T0 + timedelta(minutes=minute)).isoformat() + "Z"
    return json.dumps({"timestamp": at, "insertId": f"i{n}", "logName": "l", "protoPayload": {
        "serviceName": s, "methodName": m, "resourceName": target, "authenticationInfo": {"principalEmail": actor}}})


EVENTS = [(0, "a", "key", "k1"), (1, "a", "get", "o1"), (2, "a", "get", "o1"), (3, "b", "act", "s1"), (20, "a", "secret", "x"),
          (30, "a", "drop", "k1"), (40, "b", "get", "o2"), (41, "b", "get", "o3")]


@pytest.fixture()
def log_dir(tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    lines = [_line(*e, n) for n, e in enumerate(EVENTS)]
    (d / "a.jsonl").write_text("\n".join(lines[:5]))
    (d / "b.jsonl").write_text("\n".join(lines[3:]))  # two lines come twice
    (d / "c.jsonl").write_text(_line(60 * 24 * 3, "z", "get", "late", 99))  # pushes the watermark
    for i, name in enumerate(("a", "b", "c")):
        os.utime(d / f"{name}.jsonl", (1_700_000_000 + i * 60,) * 2)  # arrival order
    return d


def _run(query, tmp_path, name, mode="append"):
    q = (query.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    return query.sparkSession.table(name)


def _events(spark, log_dir):
    return live.dedup_stream(live.canonical_stream(raw_logs.stream_logs(spark, str(log_dir), 1)))


def test_dedup_and_resume(spark, log_dir, tmp_path):
    out = tmp_path / "events"

    def ingest():
        q = (_events(spark, log_dir).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start(str(out)))
        q.awaitTermination(120)
        return spark.read.parquet(str(out)).count()

    assert ingest() == len(EVENTS) + 1
    assert ingest() == len(EVENTS) + 1  # nothing new


def test_windows_match_batch(spark, log_dir, tmp_path):
    batch = live.canonical_stream(raw_logs.scan_logs(spark, str(log_dir))).dropDuplicates(["event_id"])
    want = {(r.window_start, r.actor_id): r for r in W.actor_windows(W.window_activity(W.target_activity(batch))).collect()
            if r.actor_id != "z"}
    got = _run(live.actor_window_stream(_events(spark, log_dir)), tmp_path, "windows").collect()
    assert {(r.window_start, r.actor_id) for r in got if r.actor_id != "z"} == set(want)
    for r in got:
        w = want.get((r.window_start, r.actor_id))
        if w:
            assert (r.event_count, r.n_targets, r.action_types) == (w.event_count, w.n_targets, w.action_types)
            assert r.breadth_entropy == pytest.approx(w.breadth_entropy)
            assert r.burst_per_min == pytest.approx(w.burst_per_min)


def test_watch_tracker(spark, log_dir, tmp_path):
    ev = live.canonical_stream(raw_logs.stream_logs(spark, str(log_dir), 1))
    got = _run(live.track_watches(ev), tmp_path, "watches", "append").collect()
    seen = {(r.resource_id, r.status): r.at for r in got}
    assert seen[("k1", "OPENED")] == T0 and seen[("k1", "CLOSED")] == T0 + timedelta(minutes=30)
    assert seen[("s1", "OPENED")] == T0 + timedelta(minutes=3)
    assert seen[("s1", "EXPIRED")] == T0 + timedelta(minutes=63)
    assert not any(k[0].startswith("o") for k in seen)


def test_sessions(spark, log_dir, tmp_path):
    timed = _events(spark, log_dir).select("ts", F.lit("l").alias("log_type"))
    # dedup already set the watermark on ts
    got = _run(timed.groupBy(F.session_window("ts", "90 seconds"), "log_type").agg(F.count(F.lit(1)).alias("n")),
               tmp_path, "sessions").collect()
    assert {4, 2} <= {r.n for r in got}


def test_live_correlation_picks_nearest(spark, tmp_path):
    d = tmp_path / "links"
    for name, df in (("links", spark.createDataFrame(
            [("svc", T0, "j1", T0), ("svc", T0 + timedelta(seconds=30), "j2", T0), ("svc", T0 + timedelta(days=2), "j3", T0)],
            "service_name string, request_ts timestamp, job_id string, scheduled_time timestamp")),
            ("audit", spark.createDataFrame(
                [("e1", "w", T0 + timedelta(seconds=40)), ("e2", "w", T0 + timedelta(seconds=500)), ("e3", "w", T0 + timedelta(days=2))],
                "event_id string, actor_id string, ts timestamp"))):
        df.write.parquet(str(d / name))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(d / n)).schema).parquet(str(d / n))
    smap = spark.createDataFrame([("svc", "w")], "service_name string, worker string")
    found = _run(live.correlate_stream(read("audit"), read("links"), smap), tmp_path, "pairs")
    got = {r.event_id: r.trigger_ref for r in found.collect()}
    assert got["e1"].startswith("sched:j2:") and got["e2"] is None


def test_live_correlation_never_pairs_events_with_requests(spark, tmp_path):
    """Three thousand events within the tolerance of three thousand requests, across slices, late requests and equal times; the batch form says which is nearest."""
    import random
    rng = random.Random(3)
    at = lambda: T0 + timedelta(seconds=rng.randrange(0, 4000))
    links = [(rng.choice(["s1", "s2", "s3", "none"]), at(), f"j{i}", T0 - timedelta(seconds=i)) for i in range(3000)]
    audit = [(f"e{i}", rng.choice(["w1", "w2", "nobody"]), at()) for i in range(3000)]
    smap = [("s1", "w1"), ("s2", "w2"), ("s3", "w1")]
    want = {}
    for e, w, t in audit:
        near = [(r, -s.timestamp(), j) for name, r, j, s in links if (name, w) in smap and timedelta(0) <= t - r < timedelta(seconds=600)]
        want[e] = (lambda b: f"sched:{b[2]}:{int(-b[1])}")(max(near)) if near else None
    links.append(("none", T0 + timedelta(days=9), "j", T0))
    audit.append(("last", "nobody", T0 + timedelta(days=9)))
    for name, data, schema in (("l", links, "service_name string, request_ts timestamp, job_id string, scheduled_time timestamp"), ("a", audit, "event_id string, actor_id string, ts timestamp")):
        spark.createDataFrame(data[:-1], schema).coalesce(1).write.parquet(str(tmp_path / name))
        spark.createDataFrame(data[-1:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    pairs = live.correlate_stream(read("a"), read("l"), spark.createDataFrame(smap, "service_name string, worker string"), CorrelationConfig(audit_seconds=600))
    kinds = pairs._jdf.queryExecution().analyzed().toString()
    got = {r.event_id: r.trigger_ref for r in _run(pairs, tmp_path, "nearest").where("event_id <> 'last'").collect()}
    assert got == want and sum(v is not None for v in want.values()) > 1000
    assert "LeftOuter" not in kinds


def test_scoring_per_batch_equals_one_batch(spark, log_dir, tmp_path):
    known = spark.createDataFrame([("w",)], "actor_id string")

    def score(ev):
        return pipeline.score_events(ev, known, tables.patterns(spark), closure.seed_pairs(spark))

    q = (live.score_batches(_events(spark, log_dir), str(tmp_path / "ev"), str(tmp_path / "risk"), score)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    batch = live.canonical_stream(raw_logs.scan_logs(spark, str(log_dir))).dropDuplicates(["event_id"])
    want = {(r.window_start, r.actor_id): r.residual_risk for r in score(batch).collect()}
    got = {(r.window_start, r.actor_id): r.residual_risk for r in spark.read.parquet(str(tmp_path / "risk")).collect()}
    assert got == pytest.approx(want)


def test_watches_equal_the_batch_form_in_any_order_of_arrival(spark, make_events, tmp_path):
    """Events arrive up to an hour and a half late, over many batches; one pair was discovered."""
    import random
    rng = random.Random(11)
    kinds = [("IAM_CREATE_KEY", "IDENTITY"), ("IAM_DELETE_KEY", "IDENTITY"), ("IAM_IMPERSONATE", "IDENTITY"), ("IAM_SET_POLICY", "CONTROL"), ("GCS_READ", "DATA"),
             ("COMPUTE_METADATA_CHANGE", "CONTROL"), ("BQ_JOB_SUBMIT", "DATA"), ("GCS_READ", "DATA"), ("GCS_READ", "DATA")]
    rows = []
    for i in range(700):
        action, zone = rng.choice(kinds)
        rows.append((rng.randrange(0, 6 * 24 * 60), rng.choice("abc"), action, zone, f"r{rng.randrange(60)}"))
    ev = make_events(rows)
    pairs = closure.seed_pairs(spark).unionByName(spark.createDataFrame([("disc", "IAM_SET_POLICY", "BQ_JOB_SUBMIT", 9, 2)], closure.seed_pairs(spark).schema))
    keys = ev.select("window_start", "actor_id").distinct()
    want = {}
    for r in closure.close_times(ev, closure.watches(ev, pairs), keys, pairs).collect():
        ends = [(t, k, s) for k, (t, s) in enumerate(((r.closing_ts, "CLOSED"), (r.expiry_ts, "EXPIRED"), (r.settled_ts, "SETTLED"))) if t is not None]
        want[r.resource_id] = (r.opening_event_id, *((min(ends)[2], min(ends)[0]) if ends else (None, None)))
    assert {w[1] for w in want.values()} >= {"CLOSED", "EXPIRED", "SETTLED"}

    order = sorted(ev.collect(), key=lambda r: r.ts + timedelta(minutes=rng.uniform(0, 90)))
    folder, cut = tmp_path / "in", -(-len(order) // 7)
    late = [order[i:i + cut] for i in range(0, len(order), cut)] + [[order[0].__class__(*order[0])]]
    for i, part in enumerate(late):
        df = spark.createDataFrame(part, ev.schema)
        if i == len(late) - 1:
            df = df.withColumns({"ts": F.col("ts") + F.expr("interval 900 days"), "target_id": F.lit("~"), "actor_id": F.lit("~")})
        df.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    messages = _run(live.track_watches(stream, pairs=pairs), tmp_path, "messages")
    ends = messages.groupBy("resource_id").agg(F.count_if(F.col("status").isin("CLOSED", "EXPIRED")).alias("n"), F.max("at").alias("last"),
                                               F.max(F.when(F.col("status").isin("CLOSED", "EXPIRED"), F.col("at"))).alias("end")).collect()
    assert all(r.n <= 1 and (r.end is None or r.end == r.last) for r in ends)  # nothing comes after the end
    messages.select("actor_id", "resource_id", "status", "at").unionByName(
        spark.sql("select '~' actor_id, '~' resource_id, 'OPENED' status, timestamp'2030-01-01' at")).write.parquet(str(tmp_path / "m"))
    keys.unionByName(spark.sql("select timestamp'2030-01-01' window_start, '~' actor_id")).write.parquet(str(tmp_path / "w"))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    closings = {r.resource_id: (r.status, r.at) for r in _run(live.settle_watches(read("m"), read("w")), tmp_path, "closings").collect()}
    opened = {r.resource_id: r.opening_event_id for r in messages.where("status = 'OPENED'").collect()}
    assert {k: (v, *closings.get(k, (None, None))) for k, v in opened.items()} == want


def test_raw_entries_arrive_as_many_files_in_three_batches(spark, tmp_path, monkeypatch):
    """A file is one task's, so large tables need many; batches stay three."""
    from shared import SF

    from flowrisk.plans import queries
    monkeypatch.setattr(queries, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(queries, "ENTRIES_PER_FILE", 100)
    n = queries.REGISTRY["stream_canonical"](spark, SF).select("event_id").distinct().count()
    assert n == queries._audit(spark, SF).select("event_id").distinct().count()
    assert len(list(tmp_path.glob("stream-*/part-*.parquet"))) >= 10
    assert len([p for p in tmp_path.glob("stream-*/state/commits/*") if p.name.isdigit()]) == 3


def test_resources_of_a_bucket_are_one_key(spark, tmp_path):
    """A key costs calls to the state, timers and tables of its own in every batch, so resources share a fixed number of them."""
    from flowrisk.streaming import watches
    spark.createDataFrame([("e", T0, "a", "GCS_READ", "DATA", "r")], "event_id string, ts timestamp, actor_id string, action_type string, target_zone string, target_id string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    plan = live.track_watches(stream, pairs=closure.seed_pairs(spark))._jdf.queryExecution().analyzed().toString()
    assert "pmod(xxhash64(resource_id" in plan and str(watches.BUCKETS) in plan
