import json

import pytest
from pyspark.sql import functions as F

from flowrisk.functions import expressions as X
from flowrisk.operators import profile as P


@pytest.mark.parametrize("value,kind", [
    ("a@b.co", "email"), ("10.0.0.1", "ipv4"), ("fe80::1", "ipv6"), ("12345", "ipv6"), ("https://x", "uri"), ("projects/p", "uri"),
    ("2024-01-01T00:00:00Z", "iso_timestamp"), ("123e4567-e89b-12d3-a456-426614174000", "uuid"), ("hello", None)])
def test_value_types(spark, value, kind):
    assert spark.createDataFrame([(value,)], "v string").select(X.value_type(F.col("v"))).first()[0] == kind


def _leaves(obj, prefix=""):
    if isinstance(obj, dict):
        for k, v in obj.items():
            yield from _leaves(v, f"{prefix}.{k}" if prefix else k)
    elif isinstance(obj, list):
        for v in obj:
            yield from _leaves(v, f"{prefix}[]")
    else:
        yield prefix, (None if obj is None else json.dumps(obj) if not isinstance(obj, str) else obj)


def test_flatten_matches_recursion(spark):
    docs = [{"a": {"b": [{"c": 1}, {"c": "x"}, [2, [3]]]}, "n": None, "e": {}, "l": []}, {"k": True, "s": "t"}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, "broken")], "id int, entry string")
    got = sorted((r.id, r.path, r.value or "") for r in P.flatten_json(df, keep=["id"]).collect())
    assert got == sorted((i, p, v or "") for i, d in enumerate(docs) for p, v in _leaves(d))


def test_flatten_keeps_what_is_too_deep(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":1}}}')], "id int, entry string")
    assert [(r.path, r.value) for r in P.flatten_json(df, keep=["id"], max_depth=2).collect()] == [("a.b", '{"c":1}')]


def test_sampling_limits_array_items(spark):
    df = spark.createDataFrame([(1, '{"a":[1,2,3,4]}')], "id int, entry string")
    assert P.flatten_json(df, keep=["id"], array_items=3).count() == 3


def test_clusters_merge_at_exact_gap(spark):
    at = [0, 30, 60, 91, 500, 531]
    df = spark.createDataFrame([(f"e{i}", s) for i, s in enumerate(at)], "id string, s int") \
        .select("id", F.timestamp_seconds("s").alias("ts"))
    sizes = [(r.n_entries) for r in P.cluster_sizes(P.temporal_clusters(df, 30.0, slice_seconds=45)).collect()]
    assert sizes == [3]


def test_cluster_keys_and_overlap(spark):
    rows = [("e1", 0, "x", "a"), ("e2", 5, "x", "b"), ("e3", 100, "y", "c"), ("e4", 101, "y", "d")]
    timed = spark.createDataFrame([(i, t) for i, t, *_ in rows], "id string, s int").select("id", F.timestamp_seconds("s").alias("ts"))
    leaves = spark.createDataFrame([(i, p, v) for i, _, k, o in rows for p, v in (("key", k), ("other", o))], "id string, path string, value string")
    shared = P.cluster_shared(leaves, P.temporal_clusters(timed))
    assert [r.path for r in P.cluster_keys(shared).collect()] == ["key"]
    places = spark.createDataFrame([("a", "p", "same", True), ("b", "q", "same", True), ("b", "r", "same", True), ("a", "s", "abc", True), ("b", "s", "abc", True)],
                                   "log_type string, path string, value string, is_string boolean")
    assert {(r.field_1, r.field_2, r.shared_values) for r in P.cross_log_overlap(places).collect()} == {("p", "q", 1), ("p", "r", 1)}


def nested(depth, inner):
    return '{"a":' * depth + inner + "}" * depth


def test_containers_open_to_any_depth(spark):
    long = "x" * 500_000 + r'\\\"{[' * 100_000
    entries = [nested(12, r'"x{[\"{["'), '{"b": [1, 2]}', nested(100, "7"), json.dumps({"s": [long]}), '{"broken": [1, 2', nested(8, "{}"), nested(8, "[]"),
               nested(9, "null"), "", None, '"top"', "[]"]
    df = spark.createDataFrame(list(enumerate(entries)), "id int, entry string")
    got = {}
    for r in P.flatten_json(df, keep=["id"]).collect():
        got.setdefault(r.id, []).append((r.path, r.value, r.is_string))
    assert got == {0: [(".".join("a" * 12), 'x{["{[', True)], 1: [("b[]", "1", False), ("b[]", "2", False)], 2: [(".".join("a" * 100), "7", False)],
                   3: [("s[]", long, True)], 7: [(".".join("a" * 9), None, False)], 10: [("", "top", True)]}


def test_broken_and_long_entries_through_the_profile(spark):
    entries = [json.dumps({"trace": "at line\n" * 20_000, "n": i % 2}) for i in range(6)] + ["{"]
    df = spark.createDataFrame([(e,) for e in entries], "entry string")
    out = {r.path: r for r in P.profile_fields(P.flatten_json(df), df.agg(F.count("*"))).collect()}
    assert (out["trace"]["count"], out["trace"].cardinality, out["n"].cardinality) == (6, 1, 2)


def test_merged_profiles_equal_one_profile(spark):
    entries = [json.dumps({"id": i, "who": f"u{i % 900}@x.co", "kind": "a" if i % 3 else "b", "odd": None if i % 2 else f"v{i % 7}"}) for i in range(6000)]
    df = spark.createDataFrame(list(enumerate(entries)), "id int, entry string")
    leaves = P.flatten_json(df, keep=["id"])
    total = df.agg(F.count("*"))
    exact = {r.path: r for r in P.profile_fields(leaves, total).collect()}
    parts = [P.profile_sketch(leaves.where(F.col("id") % 4 == k)) for k in range(4)]
    merged = {r.path: r for r in P.read_profile(P.merge_profiles(P.merge_profiles(*parts[:2]), *parts[2:]), total).collect()}
    assert merged.keys() == exact.keys()
    for path, r in exact.items():
        m = merged[path]
        assert (m["count"], m.dominant_type, m.samples, m.presence_rate) == (r["count"], r.dominant_type, r.samples, r.presence_rate)
        assert abs(m.cardinality - r.cardinality) <= 4 * 1.04 / 64 * r.cardinality


def test_entries_get_their_burst_before_they_are_opened(spark, monkeypatch):
    """The same shared paths as from leaves, while entries outside of the clustered ids are never opened."""
    rows = [(f"e{i}", json.dumps({"a": {"b": "same" if i < 3 else "other", "c": i}, "d": []})) for i in range(5)]
    entries = spark.createDataFrame([*rows, ("o1", '{"a": {"b": "order"}}'), ("o2", "{")], "id string, entry string")
    clustered = (spark.createDataFrame([(f"e{i}", 10 * i if i < 3 else 1000 + 10 * i) for i in range(5)], "id string, s long")
                 .select("id", F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds(F.when(F.col("s") < 500, 0).otherwise(1000)).alias("cluster_start")))
    want = {tuple(r) for r in P.cluster_shared(P.flatten_json(entries, keep=["id"]), clustered).collect()}
    opened, flatten = [], P.flatten_json
    monkeypatch.setattr(P, "flatten_json", lambda e, *a, **k: opened.append(e.count()) or flatten(e, *a, **k))
    got = {tuple(r) for r in P.cluster_shared_entries(entries, clustered).collect()}
    assert got == want and len(got) == 2 and opened == [5]


def test_patterns_are_tried_once_per_value(spark):
    leaves = P.flatten_json(spark.createDataFrame([('{"m": "a@example.com", "n": 1, "s": "plain"}',)] * 3, "entry string"))
    out = P.type_counts(leaves)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all(" RLIKE " not in line for line in plan.splitlines() if "Filter" in line)
    assert {r.path: (r.value_type, r.n) for r in out.collect()}["m"] == ("email", 3)


def test_sketch_reads_values_and_not_leaves(spark, monkeypatch):
    """Equal leaves are counted once; a value that stands as a string, a number and null keeps one type count and one sample."""
    seen, kind = [], P.X.value_type
    monkeypatch.setattr(P.X, "value_type", lambda v: seen.append(1) or kind(v))
    rows = ['{"a": "10.0.0.1", "b": "7"}'] * 5 + ['{"a": "10.0.0.1", "b": 7}', '{"a": null, "b": ""}', '{"a": "x", "b": null}']
    leaves = P.flatten_json(spark.createDataFrame([(r,) for r in rows], "entry string"))
    counts = P.leaf_counts(leaves)
    assert {(r.path, r.value): (r.c, r.strings) for r in counts.collect()} == {
        ("a", "10.0.0.1"): (6, 6), ("a", ""): (1, 0), ("a", "x"): (1, 1), ("b", "7"): (6, 5), ("b", ""): (2, 1)}
    got = {r.path: r for r in P.profile_sketch(leaves).collect()}
    assert {p: (r["count"], [tuple(t) for t in r.types], r.samples) for p, r in got.items()} == {
        "a": (8, [("ipv4", 6)], ["", "10.0.0.1", "x"]), "b": (8, [], ["", "7"])}
    assert len(seen) == 1
