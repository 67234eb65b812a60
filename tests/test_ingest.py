import json

import pytest
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.operators import normalize as N
from flowrisk.schema import CANONICAL_EVENT
from flowrisk.sources import raw_logs, sinks


def _entry(**over):
    base = {"timestamp": "2024-01-10T10:07:30.123456789Z", "insertId": "i1", "logName": "projects/p/logs/a",
            "resource": {"labels": {"project_id": "p"}},
            "protoPayload": {"serviceName": "storage.googleapis.com", "methodName": "storage.objects.get",
                             "resourceName": "projects/_/buckets/b/objects/o",
                             "authenticationInfo": {"principalEmail": "x@p.iam.gserviceaccount.com"}}}
    base.update(over)
    return json.dumps(base)


def _canon(spark, *entries):
    return N.canonicalize_audit(N.parse_entries(spark.createDataFrame([(e,) for e in entries], "entry string")))


@pytest.mark.parametrize("service,part,action,zone", C.METHOD_ACTIONS)
def test_every_method(spark, service, part, action, zone):
    r = _canon(spark, _entry(protoPayload={"serviceName": service, "methodName": f"v1.{part}", "resourceName": "r"})).first()
    assert (r.action_type, r.target_zone) == (action, zone)


def test_event_fields(spark):
    r = _canon(spark, _entry()).first()
    assert str(r.ts) == "2024-01-10 10:07:30.123456" and str(r.window_start) == "2024-01-10 10:00:00"
    assert r.actor_type == "SERVICE_ACCOUNT" and r.target_type == "GCS_BUCKET" and r.result == "SUCCESS"
    assert r.delegation_chain == [] and r.raw_ref == "projects/p/logs/a:i1" and len(r.event_id) == 32
    assert [c.split()[0] for c in CANONICAL_EVENT.strip().split(",")] == r.__fields__


def test_missing_parts_and_exfil(spark):
    bare = _canon(spark, _entry(protoPayload={"serviceName": "s"})).first()
    assert bare.actor_id == bare.target_id == "unknown" and bare.actor_type == "UNKNOWN" and bare.action_type == "OTHER"
    for name, zone in (("projects/_/buckets/external-x/o", "EXFIL_RISK"), ("projects/_/buckets/in/external-x", "DATA"),
                       ("storage.googleapis.com/public-d", "EXFIL_RISK")):
        p = {"serviceName": "storage.googleapis.com", "methodName": "storage.objects.get", "resourceName": name}
        assert _canon(spark, _entry(protoPayload=p)).first().target_zone == zone


def test_routing_and_quarantine(spark):
    sched = json.dumps({"timestamp": "2024-01-10T10:00:00Z", "jsonPayload": {"@type": C.SCHEDULER_TYPE_PREFIX + "AttemptStarted", "jobName": "a/b/j"}})
    call = json.dumps({"timestamp": "2024-01-10T10:00:00Z", "logName": "x/run.googleapis.com%2Frequests", "httpRequest": {"latency": "0.25s"}})
    entries = [sched, call, _entry(), json.dumps({"a": 1}), '{"cut', _entry(timestamp="never")]
    p = N.parse_entries(spark.createDataFrame([(e,) for e in entries], "entry string"))
    assert [r.log_format for r in p.collect()] == ["scheduler", "request", "audit", "unknown", "malformed", "audit"]
    assert N.quarantine(p).count() == 2
    assert N.canonicalize_scheduler(p).first().job_id == "j"
    r = N.canonicalize_requests(p).first()
    assert r.latency_seconds == 0.25 and r.status_code == 0 and r.is_scheduler_invoked is False


def test_reingest_is_idempotent(spark):
    ev = _canon(spark, _entry(), _entry(), _entry(insertId="i2")).withColumn("n", F.lit(1))
    first = N.dedup_events(ev, ["n"])
    assert first.count() == 2
    assert N.dedup_events(ev, ["n"], first).count() == 0


def test_scan_layouts(spark, tmp_path):
    d = tmp_path / "run.googleapis.com" / "x"
    d.mkdir(parents=True)
    (d / "lines.jsonl").write_text('{"a":1}\n\nnot json\n{"a":2}\n5\n')
    (d / "array.json").write_text('[{"a":3}, 4, {"a":5}]')
    (d / "pretty.json").write_text('[\n  {"a":6},\n  {"a":7}\n]\n')
    (d / "skip.txt").write_text('{"a":9}')
    (tmp_path / "other.json").write_text('{"a":8}')
    got = raw_logs.scan_logs(spark, str(tmp_path), C.LOG_PREFIXES)
    assert sorted(json.loads(r.entry)["a"] for r in got.collect()) == [1, 2, 3, 5, 6, 7]
    assert sorted(json.loads(r.entry)["a"] for r in raw_logs.scan_logs(spark, str(tmp_path)).collect()) == [1, 2, 3, 5, 6, 7, 8]
    deep = tmp_path / "deep"
    deep.mkdir()
    (deep / "a.json").write_text('[\n {\n "a": 1},\n {"a":\n 2}\n]')
    assert raw_logs.scan_logs(spark, str(deep), whole_files=True).count() == 2


def test_incremental_marks(spark):
    files = spark.createDataFrame([("s", "s/1"), ("s", "s/2"), ("t", "t/1")], "source string, path string")
    marks = spark.createDataFrame([("s", "s/1")], "source string, last_path string")
    new = raw_logs.new_files(files, marks)
    assert sorted(r.path for r in new.collect()) == ["s/2", "t/1"]
    after = raw_logs.advance_checkpoints(marks, new)
    assert {r.source: r.last_path for r in after.collect()} == {"s": "s/2", "t": "t/1"}
    assert raw_logs.new_files(files, after).count() == 0


def test_write_by_day_keeps_other_days(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-02 00:00:00", 2)], "s string, v int") \
        .select(F.to_timestamp("s").alias("window_start"), "v")
    sinks.write_by_day(df, str(tmp_path / "t"))
    sinks.write_by_day(df.where("v = 2").withColumn("v", F.lit(9)), str(tmp_path / "t"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 9]
    assert sinks.read_history(spark, str(tmp_path / "t"), "2024-01-03 00:00:00", 1).count() == 1


def test_odd_field_types_cost_only_the_field(spark):
    entry = {"timestamp": "2024-01-10T10:00:00Z", "insertId": "x", "logName": "l", "protoPayload": {
        "serviceName": "s", "methodName": "m", "resourceName": "r", "authenticationInfo": {"principalEmail": "a@b"}}}
    cases = [entry | {"httpRequest": {"status": "abc"}}, entry | {"resource": "text"}, entry]
    cases[0]["protoPayload"] = entry["protoPayload"] | {"status": {"code": "7"}}
    texts = [json.dumps(c) for c in cases] + ["{not json", "[1, 2]", "7"]
    parsed = N.parse_entries(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, entry string"))
    assert {r.i: r.log_format for r in parsed.select("i", "log_format").collect()} == dict(enumerate(["audit"] * 3 + ["malformed"] * 3))
    assert sorted(r.result for r in N.canonicalize_audit(parsed).collect()) == ["FAIL", "SUCCESS", "SUCCESS"]
