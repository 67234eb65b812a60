"""One runnable query per operator, over the benchmark tables.

Each callable takes (spark, sf_dir). Floats are rounded to six decimals, times
are UTC text, arrays are comma-joined, so that results compare by value.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.config import ClosureConfig, CorrelationConfig
from flowrisk.functions import expressions as X
from flowrisk.operators import (
    audits, closure, correlate, evaluate, invariants, normalize, profile, provenance, scoring, trajectory, world,
)
from flowrisk.plans import pipeline
from flowrisk.plans import tables as T
from flowrisk.sources import raw_logs, sinks
from flowrisk.session import materialize, shared_folder, tune
from flowrisk.streaming import live

DAY = T.DAY
REGISTRY: dict = {}


def query(fn):
    """Register a query under its name (a trailing underscore avoids a module name)."""
    def run(spark, sf_dir):
        return fn(tune(spark), sf_dir)
    run.__name__, run.__doc__ = fn.__name__.rstrip("_"), fn.__doc__
    REGISTRY[run.__name__] = run
    return fn


def r6(c) -> Column:
    """Round to six decimals and drop the sign of zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def text(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c) -> Column:
    return F.array_join(c, ",")


def key() -> list:
    return [text("window_start").alias("window_start"), F.col("actor_id")]


def _events(spark, sf) -> DataFrame:
    return T.canonical_events(spark, sf)


def _edges(spark, sf) -> DataFrame:
    return materialize(world.edge_novelty(materialize(world.zone_edges(_events(spark, sf), DAY), "transitions"), DAY),
                       "edges")


def _flux(spark, sf) -> DataFrame:
    return materialize(world.zone_flux(_events(spark, sf), _edges(spark, sf), DAY), "flux")


def _risk(spark, sf, *columns: str) -> DataFrame:
    """Risk rows, written once; with ``columns`` only what these need is worked out."""
    risk = pipeline.score_events(_events(spark, sf), T.known_initiators(spark, sf), T.patterns(spark), closure.seed_pairs(spark), DAY)
    return materialize(risk.select(*columns) if columns else risk, "risk")


def _fused(spark, sf) -> DataFrame:
    pairs = closure.seed_pairs(spark)
    return materialize(pipeline.fusion(pipeline.build_world(_events(spark, sf), pairs, DAY),
                                       T.known_initiators(spark, sf), pairs), "fused")


# --- windows, edges, flux ------------------------------------------------------

@query
def actor_windows(spark, sf):
    w = world.actor_windows(world.window_activity(world.target_activity(_events(spark, sf))))
    return w.select(*key(), "event_count", "n_targets", joined("action_types").alias("action_types"),
                    r6("burst_per_min").alias("burst_per_min"),
                    r6("breadth_entropy").alias("breadth_entropy"), "provenance_level")


@query
def breadth_entropy(spark, sf):
    w = world.window_activity(world.target_activity(_events(spark, sf)))
    return w.select(*key(), r6("breadth_entropy").alias("breadth_entropy"))


@query
def window_targets(spark, sf):
    return world.window_targets(world.target_activity(_events(spark, sf))).select(*key(), "target_id", "hits")


@query
def zone_sequences(spark, sf):
    return world.zone_sequences(_events(spark, sf), DAY).select(*key(), "position", "target_zone")


@query
def zone_edges(spark, sf):
    e = world.zone_edges(_events(spark, sf), DAY)
    return e.select(*key(), "source_zone", "target_zone", "target_id", "edge_count",
                    F.unix_micros("first_seen").alias("first_seen"))


@query
def edge_novelty(spark, sf):
    return _edges(spark, sf).select(*key(), "source_zone", "target_zone", "target_id", "is_new")


@query
def zone_flux(spark, sf):
    size = len(C.ZONES)
    cells = F.flatten("flux_matrix")
    flat = F.array_join(F.transform(cells, lambda v: v.cast("long").cast("string")), ",")
    net = F.array_join(F.transform(F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.concat_ws("_", i, j)))),
        lambda k: F.coalesce(F.try_element_at("net_currents", k), F.lit(0.0)).cast("long").cast("string")), ",")
    return _flux(spark, sf).select(text("window_start").alias("window_start"), flat.alias("flux_matrix"),
                                   net.alias("net_currents"), r6("sigma_coarse").alias("sigma_coarse"),
                                   "bridge_count")


@query
def sigma_coarse(spark, sf):
    pairs = world.flux_pairs(world.flux_cells(world.zone_edges(_events(spark, sf), DAY)))
    return world.entropy_production(pairs, DAY).select(
        text("window_start").alias("window_start"), r6("sigma_coarse").alias("sigma_coarse"))


@query
def bridge_count(spark, sf):
    return world.bridge_counts(_edges(spark, sf)).select(text("window_start").alias("window_start"), "bridge_count")


@query
def ema_delta(spark, sf):
    return world.ema_delta(_flux(spark, sf), DAY).select(
        text("window_start").alias("window_start"), r6("sigma_coarse").alias("sigma_coarse"),
        r6("delta_f").alias("delta_f"))


@query
def novelty_score(spark, sf):
    return world.novelty_scores(_edges(spark, sf)).select(*key(), r6("novelty_score").alias("novelty_score"))


# --- invariants ----------------------------------------------------------------

def _activity(spark, sf):
    targets = materialize(world.target_activity(_events(spark, sf)), "targets")
    return targets, world.window_activity(targets)


@query
def inv_simple(spark, sf):
    _, activity = _activity(spark, sf)
    return invariants.simple_rules(activity, T.known_initiators(spark, sf)).select(
        *key(), "INV_001", "INV_002", "INV_003", "INV_004", "INV_007", "INV_009")


@query
def inv_spike(spark, sf):
    _, activity = _activity(spark, sf)
    return invariants.impersonation_spike(activity, DAY).where(F.col("n_impersonate") > 0).select(
        *key(), "n_impersonate", r6("impersonation_baseline").alias("impersonation_baseline"), "INV_005")


@query
def inv_novel_access(spark, sf):
    targets, _ = _activity(spark, sf)
    return invariants.novel_access(targets, DAY).select(*key(), "INV_006", "INV_008")


@query
def novel_access(spark, sf):
    """Set-membership lookback at (window, actor, target) grain."""
    targets, _ = _activity(spark, sf)
    return world.mark_new(targets.where(F.col("n_secret") > 0), ["actor_id", "target_id"],
                          DAY.lookback_seconds, "is_new").select(*key(), "target_id", "is_new")


@query
def inv_new_edge(spark, sf):
    return invariants.new_sensitive_edge(_edges(spark, sf)).select(*key(), "INV_010")


@query
def inv_delegation(spark, sf):
    _, activity = _activity(spark, sf)
    return invariants.missing_delegation(activity, DAY).select(*key(), "past_chained", "past_events", "INV_011")


def _invariants(spark, sf):
    targets, activity = _activity(spark, sf)
    return invariants.check_invariants(activity, targets, _edges(spark, sf), T.known_initiators(spark, sf), DAY)


@query
def invariants_(spark, sf):
    return _invariants(spark, sf).select(*key(), "inv_score", "inv_count",
                                         joined("fired_invariants").alias("fired_invariants"))


@query
def risk_explanations(spark, sf):
    """The sentences of the fired rules of every window."""
    ev, edges = _events(spark, sf), _edges(spark, sf)
    targets = materialize(world.target_activity(ev), "targets")
    activity = materialize(world.window_activity(targets), "activity")
    flags = invariants.check_invariants(activity, targets, edges, T.known_initiators(spark, sf), DAY)
    return invariants.explain(ev, flags, activity, edges, targets, DAY).select(*key(), "explanation")


# --- closure ---------------------------------------------------------------------

@query
def closure_watches(spark, sf):
    w = closure.watches(_events(spark, sf), closure.seed_pairs(spark))
    return w.select("resource_id", "resource_type", "opening_event_id", F.unix_micros("opening_ts").alias("opening_ts"),
                    "opening_actor_id", "expected_close_type", "window_hours", "sensitivity")


@query
def closure_closed(spark, sf):
    ev, pairs = _events(spark, sf), closure.seed_pairs(spark)
    c = closure.explicit_closings(ev, closure.watches(ev, pairs), pairs)
    return c.select("resource_id", F.unix_micros("closing_ts").alias("closing_ts"), "closing_event_id")


def _closed(spark, sf):
    ev, pairs = _events(spark, sf), closure.seed_pairs(spark)
    keys = materialize(ev.select(*world.WINDOW_KEY).distinct(), "keys")
    opened = materialize(closure.watches(ev, pairs), "watches")
    return materialize(closure.close_times(ev, opened, keys, pairs, ClosureConfig()), "closed"), keys


@query
def closure_settled(spark, sf):
    closed, _ = _closed(spark, sf)
    return closed.where(F.col("settled_ts").isNotNull()).select("resource_id", text("settled_ts").alias("settled_ts"))


def _closure(spark, sf, point_in_time):
    closed, keys = _closed(spark, sf)
    return closure.closure_signals(closed, keys, DAY, point_in_time).select(
        *key(), "total_watches", "closed_watches", r6("closure_ratio").alias("closure_ratio"),
        r6("orphaned_privilege").alias("orphaned_privilege"))


@query
def closure_signals(spark, sf):
    return _closure(spark, sf, True)


@query
def closure_signals_lookahead(spark, sf):
    """Openings and explicit closings of all times count, as when ingest ends before scoring."""
    return _closure(spark, sf, False)


@query
def mine_pairs(spark, sf):
    return closure.mine_pairs(_events(spark, sf)).select(
        "candidate_id", "opening_action_type", "closing_action_type", "obs_count",
        r6("median_gap_hours").alias("median_gap_hours"))


@query
def promote_pairs(spark, sf):
    return closure.promote_pairs(closure.mine_pairs(_events(spark, sf)), closure.seed_pairs(spark))


@query
def candidate_status(spark, sf):
    return closure.candidate_status(closure.mine_pairs(_events(spark, sf)), closure.seed_pairs(spark)).select(
        "candidate_id", "obs_count", "promoted_to")


# --- fusion, provenance, policy ---------------------------------------------------

@query
def fusion_score(spark, sf):
    return _fused(spark, sf).select(
        *key(), "inv_score", "inv_count", r6("novelty_score").alias("novelty_score"), "bridge_new",
        *[r6(c).alias(c) for c in ("sigma_coarse", "delta_f", "closure_ratio", "orphaned_privilege", "fusion_raw")])


@query
def lcs_zone_match(spark, sf):
    z = provenance.zone_match(world.zone_sequences(_events(spark, sf), DAY), T.patterns(spark))
    return z.select(*key(), "pattern_id", r6("zone_score").alias("zone_score"))


def _matches(spark, sf):
    ev = _events(spark, sf)
    activity = world.window_activity(world.target_activity(ev))
    return provenance.pattern_match(activity, world.zone_sequences(ev, DAY), T.patterns(spark))


@query
def pattern_match(spark, sf):
    return _matches(spark, sf).select(*key(), r6("pattern_match_score").alias("pattern_match_score"),
                                      "matched_pattern_id")


@query
def pattern_usage(spark, sf):
    return provenance.pattern_usage(_matches(spark, sf)).select(
        "pattern_id", "match_count", text("last_matched_ts").alias("last_matched_ts"))


@query
def dominant_provenance(spark, sf):
    return provenance.dominant_provenance(_events(spark, sf)).select(*key(), "provenance_level", "trigger_ref")


@query
def trigger_chain(spark, sf):
    ev = _events(spark, sf)
    return provenance.trigger_chains(ev, ev, T.known_initiators(spark, sf))


@query
def enrich_provenance(spark, sf):
    ev = _events(spark, sf).drop("provenance_level", "provenance_source")
    return provenance.enrich_provenance(ev, T.known_initiators(spark, sf)).select(
        "event_id", "provenance_level", "provenance_source")


@query
def residual_risk(spark, sf):
    return _risk(spark, sf).select(
        *key(), r6("fusion_raw").alias("fusion_raw"), r6("pattern_match_score").alias("pattern_match_score"),
        "matched_pattern_id", "provenance_level", "trigger_chain_resolved",
        r6("residual_risk").alias("residual_risk"), "tier")


@query
def risk_energy(spark, sf):
    return scoring.risk_energy(_risk(spark, sf)).select(*key(), r6("risk_energy").alias("risk_energy"), "alert_level")


@query
def policy_suggestions(spark, sf):
    return scoring.policy_suggestions(scoring.risk_energy(_risk(spark, sf))).select(
        "suggestion_id", *key(), r6("risk_energy").alias("risk_energy"), "alert_level", "suggested_action")


@query
def tier_counts(spark, sf):
    return _risk(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))




# --- ingestion ---------------------------------------------------------------------

def _parsed(spark, sf):
    return normalize.parse_entries(T.raw_entries(spark, sf))


def _audit(spark, sf):
    return normalize.canonicalize_audit(_parsed(spark, sf))


@query
def scan_raw_logs(spark, sf):
    lines = raw_logs.select_prefixes(T.raw_lines(spark, sf), C.LOG_PREFIXES)
    entries = raw_logs.split_entries(lines)
    return (entries.withColumn("source", raw_logs.source_of(F.col("source_file")))
            .groupBy("source", F.get_json_object("entry", "$.insertId").alias("insert_id"))
            .agg(F.count(F.lit(1)).alias("n")))


@query
def incremental_files(spark, sf):
    """New files per source and the marks after reading them; a file is one hour of one event type."""
    files = T.table(spark, sf, "events").select(
        F.col("event_type").alias("source"),
        F.concat("event_type", F.lit("/"), F.date_format("ts", "yyyy/MM/dd/HH"), F.lit(".jsonl")).alias("path")).distinct()
    marks = files.where(F.col("source") != "view").groupBy("source").agg(F.max("path").alias("_p")).select(
        "source", F.concat("source", F.lit("/2024/01/15/12.jsonl")).alias("last_path"))
    new = raw_logs.new_files(files, marks)
    after = raw_logs.advance_checkpoints(marks, new)
    return (new.groupBy("source").agg(F.count(F.lit(1)).alias("n_new"), F.min("path").alias("first_new"))
            .join(after, "source"))


@query
def route_formats(spark, sf):
    return _parsed(spark, sf).select("event_id", "log_format")


@query
def ingest_stats(spark, sf):
    return normalize.ingest_stats(_parsed(spark, sf))


@query
def quarantined_entries(spark, sf):
    return normalize.quarantine(_parsed(spark, sf)).select("event_id", "log_format")


@query
def canonicalize_audit(spark, sf):
    return _audit(spark, sf).select(
        "event_id", F.unix_micros("ts").alias("ts"), text("window_start").alias("window_start"), "actor_id",
        "action_subtype", "target_id", "result", "project_id", "trigger_ref", "provenance_level",
        joined("delegation_chain").alias("delegation_chain"), "raw_ref", "env", "is_deploy")


@query
def known_accounts(spark, sf):
    """Events of accounts that a project's list names, by account: names carry the project's id and number."""
    users = T.table(spark, sf, "events").where("user_id % 6 = 0").select("user_id").distinct()
    names = users.select(F.concat(F.lit("u"), "user_id", F.lit("@PROJECT_ID.iam.gserviceaccount.com")).alias("name")).unionByName(
        spark.createDataFrame([("service-PROJECT_NUMBER@gcp-sa-cloudscheduler.iam.gserviceaccount.com",)], "name string"))
    known = names.select(X.resolved_account(F.col("name"), "p", "1").alias("actor_id")).distinct()
    n = _events(spark, sf).groupBy("actor_id").agg(F.count(F.lit(1)).alias("n"))
    return known.join(n, "actor_id", "left").select("actor_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_events"))


@query
def pattern_registry(spark, sf):
    """Patterns of every second user; those of every third are added, one is switched off: which are active, and from where."""
    n = T.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("rate_max"))
    named = n.withColumn("pattern_id", F.concat(F.lit("p"), "user_id"))
    first = named.where("user_id % 2 = 0").select("pattern_id", "rate_max", F.lit("first").alias("origin"), (F.col("user_id") % 10 != 0).alias("active"))
    new = named.where("user_id % 3 = 0").select("pattern_id", "rate_max", F.lit("second").alias("origin"))
    held = provenance.deactivate_pattern(provenance.register_pattern(first, new), "p12")
    return provenance.active_patterns(held).select("pattern_id", "rate_max", "origin")


@query
def event_content_id(spark, sf):
    return _audit(spark, sf).select(F.substring_index("raw_ref", ":", -1).alias("insert_id"), "event_id")


@query
def map_actions(spark, sf):
    return _audit(spark, sf).select("event_id", "action_type", "target_type", "target_zone")


@query
def exfil_reclass(spark, sf):
    return (_audit(spark, sf).where(F.col("target_zone") == "EXFIL_RISK")
            .groupBy("action_type", "target_id").agg(F.count(F.lit(1)).alias("n")))


@query
def actor_class(spark, sf):
    return _audit(spark, sf).select("actor_id", "actor_type", "is_infrastructure").distinct()


@query
def parse_ts(spark, sf):
    """Timestamps with nine, three and no fraction digits."""
    e = T.table(spark, sf, "events")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    forms = F.array(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("999Z")),
                    F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")),
                    F.concat(base, F.lit("Z")), F.lit("not a time"))
    return e.select("event_id", F.posexplode(forms).alias("form", "raw")).select(
        "event_id", "form", F.unix_micros(X.parse_ts(F.col("raw"))).alias("parsed"))


@query
def floor_window(spark, sf):
    return T.table(spark, sf, "events").select(
        "event_id", text(X.floor_window(F.col("ts"), 15)).alias("w15"), text(X.floor_window(F.col("ts"), 5)).alias("w5"))


@query
def canonicalize_scheduler(spark, sf):
    return normalize.canonicalize_scheduler(_parsed(spark, sf)).select(
        "insert_id", "job_id", "target_url", "attempt_type", F.unix_micros("timestamp").alias("at"),
        F.unix_micros("scheduled_time").alias("scheduled"), "http_status", "project_id")


@query
def canonicalize_requests(spark, sf):
    return normalize.canonicalize_requests(_parsed(spark, sf)).select(
        "insert_id", "service_name", "request_url", "status_code", F.unix_micros("timestamp").alias("at"),
        r6("latency_seconds").alias("latency_seconds"), "is_scheduler_invoked", "project_id")


@query
def dedup_events(spark, sf):
    """Every entry arrives twice; half of the ids with an even last digit are stored already."""
    first = _audit(spark, sf).withColumn("arrival", F.lit(1))
    again = _audit(spark, sf).withColumn("arrival", F.lit(2))
    stored = first.where(F.substring("event_id", 32, 1).isin("0", "2", "4", "6")).select("event_id")
    out = normalize.dedup_events(first.unionByName(again), ["arrival", "ts"], stored)
    return out.select("event_id", "arrival", "actor_id")


# --- correlation ---------------------------------------------------------------------

# Table times are minutes apart, so tolerances are in minutes here.
WIDE = CorrelationConfig(link_seconds=3600, audit_seconds=7200, slice_seconds=14400)


@query
def link_sched_requests(spark, sf):
    links = correlate.link_requests(T.scheduler_runs(spark, sf), T.service_requests(spark, sf), WIDE)
    return links.select("project_id", "scheduler_id", "request_id", "url_match", "service_name")


@query
def sched_cadence(spark, sf):
    return correlate.cadence(T.scheduler_runs(spark, sf), WIDE).select(
        "project_id", r6("cadence_seconds").alias("cadence_seconds"))


@query
def link_candidates(spark, sf):
    c = correlate.candidate_counts(T.request_links(spark, sf), T.service_requests(spark, sf), WIDE)
    return c.select("scheduler_id", "candidate_count")


def _correlated(spark, sf):
    return correlate.correlate_events(
        T.audit_events(spark, sf), T.request_links(spark, sf), T.service_requests(spark, sf),
        T.scheduler_runs(spark, sf), T.service_map(spark), WIDE)


@query
def correlate_audit(spark, sf):
    return _correlated(spark, sf).select("event_id", "actor_id", "trigger_ref", "scheduler_id", "request_id")


@query
def correlation_confidence(spark, sf):
    return _correlated(spark, sf).select("event_id", F.round("correlation_confidence", 4).alias("correlation_confidence"))


def _validated(spark, sf):
    return correlate.validate_service_map(T.request_links(spark, sf), T.audit_events(spark, sf),
                                          T.service_map(spark), WIDE)


@query
def validate_service_map(spark, sf):
    return _validated(spark, sf)


@query
def hydration_summary(spark, sf):
    return correlate.hydration_summary(_validated(spark, sf))


# --- ablation and detection ------------------------------------------------------------

ZEROED = ["closure_gap", "orphaned_priv"]


def user() -> Column:
    return F.regexp_extract("actor_id", r"^u(\d+)", 1).cast("long")


def role() -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in ("worker", "attacker", "reader", "other")]),
                        (user() % 4 + 1).cast("int"))


def scenario() -> Column:
    return F.concat(F.lit("s"), user() % 5)


def _ablated(spark, sf, mode="zero"):
    return evaluate.ablate(_fused(spark, sf), ZEROED, mode)


@query
def ablation(spark, sf):
    return _ablated(spark, sf).select(*key(), *[r6(c).alias(c) for c in ("fusion_raw", "ablated", "delta")],
                                      "old_tier", "new_tier")


@query
def tier_migration(spark, sf):
    return evaluate.tier_migration(_ablated(spark, sf, "redistribute"))


@query
def ablation_stats(spark, sf):
    return evaluate.ablation_stats(_ablated(spark, sf)).select(
        *[r6(c).alias(c) for c in ("mean", "median", "stdev", "max")])


@query
def ablation_top(spark, sf):
    return evaluate.ablation_top(_ablated(spark, sf)).select(
        *key(), r6("delta").alias("delta"), joined("dominant_signals").alias("dominant_signals"))


@query
def role_stats(spark, sf):
    out = evaluate.role_stats(_fused(spark, sf), ZEROED, "worker", role())
    floats = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[r6(c).alias(c) if c in floats else F.col(c) for c in out.columns])


@query
def role_extract(spark, sf):
    """Role prefixes of account names, with and without the separator."""
    c = T.table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(
        F.concat(F.lower("c_mktsegment"), F.lit("-sa-"), "c_custkey", F.lit("@p.iam.gserviceaccount.com")))
    return c.select(X.role_of(name).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query
def scenario_summary(spark, sf):
    s = evaluate.scenario_summary(_risk(spark, sf).withColumn("scenario", scenario()), ["scenario"])
    return s.select("scenario", r6("max_residual").alias("max_residual"), r6("mean_residual").alias("mean_residual"),
                    "max_tier", joined("fired_invariants").alias("fired_invariants"), "n_pairs")


@query
def role_gap(spark, sf):
    g = evaluate.role_gap(_risk(spark, sf).withColumn("scenario", scenario()), ["scenario"], role() == "attacker", role() == "worker")
    return g.select("scenario", *[r6(c).alias(c) for c in g.columns if c != "scenario"])


def _activation(spark, sf) -> DataFrame:
    risk = _risk(spark, sf, "actor_id", "inv_score", "novelty_score", "bridge_new", "closure_ratio", "orphaned_privilege", "trigger_chain_resolved")
    return evaluate.signal_activation(risk.withColumn("scenario", scenario()), ["scenario"])


@query
def signal_activation(spark, sf):
    g = _activation(spark, sf)
    return g.select("scenario", *[r6(c).alias(c) for c in g.columns if c != "scenario"])


@query
def signal_reliability(spark, sf):
    """Scenarios stand for runs."""
    g = _activation(spark, sf)
    out = evaluate.signal_reliability(g, [c for c in g.columns if c != "scenario"])
    return out.select("signal", r6("reliability").alias("reliability"), r6("mean_activation").alias("mean_activation"))


def _signal_max(spark, sf):
    return evaluate.signal_max(_risk(spark, sf), ["actor_id"])


@query
def signal_max(spark, sf):
    g = _signal_max(spark, sf)
    return g.select(*[r6(c).alias(c) if c.endswith("_max") else F.col(c) for c in g.columns])


@query
def prediction_divergence(spark, sf):
    expected = F.when(user() % 2 == 0, F.array(F.lit("inv_score"), F.lit("delta_f"))).otherwise(F.array(F.lit("closure_gap")))
    return evaluate.prediction_divergence(_signal_max(spark, sf).withColumn("expected_signals", expected))


@query
def sweep_report(spark, sf):
    out = evaluate.sweep_report(T.table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"])
    return out.select("axis", "level", "runs", *[F.round(c, 3).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query
def detection_by_axis(spark, sf):
    out = evaluate.detection_by_axis(T.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"],
                                     F.col("o_totalprice") > 200000)
    return out.select("axis", "level", "n", r6("rate").alias("rate"), "verdict")


@query
def blind_spots(spark, sf):
    o = T.table(spark, sf, "orders")
    return evaluate.blind_spots(o, F.col("o_totalprice") > 200000, [F.col("o_totalprice").desc(), "o_orderkey"]).select(
        "o_orderkey", "o_orderstatus", r6("o_totalprice").alias("o_totalprice"))


PROBS = {"p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


@query
def residual_percentiles(spark, sf):
    p = evaluate.residual_percentiles(_risk(spark, sf, "actor_id", "residual_risk").withColumn("scenario", scenario()), ["scenario"], "residual_risk", PROBS)
    return p.select("scenario", "n", *[r6(c).alias(c) for c in PROBS])


def _split(spark, sf):
    risk = _risk(spark, sf)
    return risk.where(user() % 10 == 0), risk.where(user() % 10 != 0)


@query
def recalibrate(spark, sf):
    out = evaluate.recalibrate(*_split(spark, sf), "residual_risk")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query
def recalibrated_tiers(spark, sf):
    attack, benign = _split(spark, sf)
    limits = evaluate.recalibrate(attack, benign, "residual_risk")
    return (evaluate.with_recalibrated_tier(attack, limits, "residual_risk")
            .groupBy("recal_tier", "recal_detected").agg(F.count(F.lit(1)).alias("n")))


@query
def embed_in_baseline(spark, sf):
    ev = _events(spark, sf)
    both = evaluate.embed_in_baseline(ev, ev.where(F.col("user_id") % 10 == 0))
    return (world.window_activity(world.target_activity(both))
            .select(*key(), "event_count", "n_targets"))


@query
def separation_stats(spark, sf):
    s = evaluate.separation_stats(T.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
    return s.select("l_returnflag", "count", *[F.round(c, 3).alias(c) for c in
                                               ("mean", "std", "min", "p25", "p50", "p75", "p90", "max")])


@query
def separation_odd_values(spark, sf):
    """The same over a category with nulls and values with one far outlier."""
    rows = T.table(spark, sf, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("category"),
        F.when((F.col("l_orderkey") == 1) & (F.col("l_linenumber") == 1), 1e12).otherwise(F.col("l_extendedprice").cast("double")).alias("v"))
    s = evaluate.separation_stats(rows, "category", "v")
    return s.select("category", "count", *[F.round(c, 2).alias(c) for c in ("min", "p25", "p50", "p75", "p90", "max")])


@query
def effect_size(spark, sf):
    s = evaluate.effect_size(T.table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", "l_extendedprice")
    return s.select(F.round("attack_mean", 3).alias("attack_mean"), F.round("benign_mean", 3).alias("benign_mean"),
                    r6("cohens_d").alias("cohens_d"), r6("separation_ratio").alias("separation_ratio"))


# --- trajectories ------------------------------------------------------------------------

def _transitions(spark, sf):
    return materialize(trajectory.from_state_visits(T.state_visits(spark, sf)), "transitions")


@query
def trajectories(spark, sf):
    return trajectory.positions(_transitions(spark, sf)).select("actor", "seq", "src", "dst", "action", "position")


MONTH_START = 1704067200  # 2024-01-01 UTC


@query
def trajectory_slice(spark, sf):
    """State space of the first ten transitions of each actor between day 5 and day 20."""
    part = trajectory.between(_transitions(spark, sf), MONTH_START + 5 * 86400, MONTH_START + 20 * 86400)
    return trajectory.state_space(trajectory.truncate(part, 10)).groupBy("actor").agg(F.count(F.lit(1)).alias("n_states"))


@query
def trajectory_reversed(spark, sf):
    return trajectory.reverse(_transitions(spark, sf)).select("actor", "seq", "src", "dst", F.round("t", 3).alias("t"))


@query
def kl_irreversibility(spark, sf):
    return trajectory.kl_irreversibility(_transitions(spark, sf)).select("actor", r6("kl").alias("kl"))


@query
def flux_divergence(spark, sf):
    return trajectory.flux_divergence(_transitions(spark, sf)).select(
        "actor", "n_transitions", r6("flux_l1").alias("flux_l1"), r6("flux_max").alias("flux_max"))


@query
def node_divergence(spark, sf):
    return trajectory.node_divergence(_transitions(spark, sf)).select("actor", "node", r6("divergence").alias("divergence"))


@query
def excess_kl(spark, sf):
    tr = _transitions(spark, sf)
    return trajectory.excess_kl(tr, trajectory.last_windows(tr, 20)).select(
        "actor", "n_window", "n_baseline", r6("excess").alias("excess"))


def _rolling(spark, sf):
    return materialize(trajectory.rolling_excess(_transitions(spark, sf), 20), "rolling")


@query
def rolling_excess(spark, sf):
    return _rolling(spark, sf).select("actor", "end_position", r6("score").alias("score"))


@query
def entropy_rate(spark, sf):
    return trajectory.entropy_rate(_transitions(spark, sf), 20).select("actor", r6("entropy_rate").alias("entropy_rate"))


@query
def transitions_per_actor(spark, sf):
    return trajectory.transitions_per_actor(_transitions(spark, sf))


@query
def pseudonymize(spark, sf):
    tr = _transitions(spark, sf)
    out = trajectory.pseudonymize(tr, 7)
    return out.select("actor", "src", "dst", "action", F.round("t", 2).alias("t"))


# --- alert budget and behavioural read ------------------------------------------------------

def _alerts(spark, sf):
    return _rolling(spark, sf).select("actor", "window_time", F.round("score", 9).alias("score"))


def _budgeted(spark, sf):
    return evaluate.alert_budget(_alerts(spark, sf), 3)


@query
def alert_budget(spark, sf):
    return _budgeted(spark, sf).select("actor", "day", "rank", r6("score").alias("score"))


@query
def campaign_detection(spark, sf):
    d = evaluate.campaign_detection(T.campaigns(spark, sf), _budgeted(spark, sf))
    return d.select("actor", "flavor", "detected", F.round("alert_time", 3).alias("alert_time"),
                    r6("alert_score").alias("alert_score"), "budget_day")


@query
def budget_eval(spark, sf):
    d = evaluate.campaign_detection(T.campaigns(spark, sf), _budgeted(spark, sf))
    return evaluate.budget_eval(d).select("flavor", "total", "tp", "fn", r6("detection_rate").alias("detection_rate"))


@query
def campaigns_per_flavor(spark, sf):
    return evaluate.campaigns_per_flavor(T.campaigns(spark, sf))


@query
def behavioural_read(spark, sf):
    """Excess of labelled intervals by flavor, and of the middle of unlabelled trajectories."""
    tr, marked = _transitions(spark, sf), T.campaigns(spark, sf)
    placed = materialize(trajectory.positions(tr), "positions")
    spans = materialize(evaluate.instance_windows(placed, marked).unionByName(
        evaluate.middle_windows(placed, marked, 20, 40)), "spans")
    scored = trajectory.excess_kl(tr, spans.drop("flavor")).withColumn("flavor", F.substring_index("window_id", "|", 1))
    s = evaluate.against_benign(evaluate.separation_stats(scored, "flavor", "excess"), "flavor")
    return s.select("flavor", "count", *[r6(c).alias(c) for c in (
        "mean", "std", "min", "p25", "p50", "p75", "p90", "max", "cohens_d", "separation_ratio")])


# --- audits ------------------------------------------------------------------------------------

def _spans(spark, sf):
    return audits.benign_spans(_transitions(spark, sf), T.campaigns(spark, sf))


@query
def benign_spans(spark, sf):
    return _spans(spark, sf).select("actor", "span", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"))


def _samples(spark, sf):
    tr = _transitions(spark, sf)
    benign = _spans(spark, sf).select("actor", "t_start", "t_end", F.lit("benign").alias("flavor"), F.lit(0).alias("y"))
    marked = T.campaigns(spark, sf).select("actor", "t_start", "t_end", "flavor", F.lit(1).alias("y"))
    spans = materialize(benign.unionByName(marked).withColumn(
        "sample", F.concat_ws("|", "actor", "y", F.floor("t_start").cast("string"))), "spans")
    return spans.join(audits.span_features(tr, spans, "sample"), "sample")


@query
def span_features(spark, sf):
    return _samples(spark, sf).select("actor", "flavor", F.round("t_start", 3).alias("t_start"),
                                      *[r6(c).alias(c) for c in audits.FEATURES])


@query
def average_precision(spark, sf):
    e = T.raw_events(spark, sf).select("event_type", (F.col("k") / F.lit(100.0)).alias("score"),
                                       (F.col("value") > 20).cast("int").alias("label"))
    return audits.average_precision(e, ["event_type"], "score", "label").select(
        "event_type", r6("average_precision").alias("average_precision"), r6("prevalence").alias("prevalence"))


@query
def leakage_audit(spark, sf):
    s = _samples(spark, sf)
    return audits.leakage_audit(s, F.pmod(F.xxhash64("actor"), F.lit(10)) < 6)


@query
def bootstrap_intervals(spark, sf):
    """Interval of the average precision with which an order's value tells urgent ones, per status; values in thousands, so many are equal."""
    o = T.table(spark, sf, "orders").select("o_orderstatus", F.floor(F.col("o_totalprice").cast("double") / 1000).cast("double").alias("v"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    b = audits.bootstrap_intervals(o, ["o_orderstatus"], "v", "y", replicates=200)
    return b.select("o_orderstatus", r6("ci_lower").alias("ci_lower"), r6("ci_upper").alias("ci_upper"))


@query
def ks_two_sample(spark, sf):
    o = T.table(spark, sf, "orders")
    k = audits.ks_two_sample(o, "o_totalprice", F.col("o_orderstatus") == "F")
    return k.select("n1", "n2", r6("statistic").alias("statistic"), r6("p_value").alias("p_value"))


@query
def degree_dist(spark, sf):
    return audits.degree_dist(_transitions(spark, sf), []).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


@query
def iqr_check(spark, sf):
    n = trajectory.transitions_per_actor(_transitions(spark, sf)).withColumn(
        "u", F.substring("actor", 2, 20).cast("long"))
    out = audits.iqr_check(n.where("u % 10 != 0"), n.where("u % 10 = 0"), "n_transitions")
    return out.select(r6("q1").alias("q1"), r6("q3").alias("q3"), "n", "n_outside", "passed")


@query
def activity_check(spark, sf):
    out = audits.activity_check(trajectory.transitions_per_actor(_transitions(spark, sf)))
    return out.select("n_actors", "min", "median", r6("mean").alias("mean"), "passed")


@query
def leak_scan(spark, sf):
    return audits.leak_scan(T.table(spark, sf, "documents").drop("n_chars"), ["doc_id"])


# --- log profiling -------------------------------------------------------------------------------

def _entries(spark, sf):
    return profile.with_log_type(T.mixed_entries(spark, sf))


def _leaves(spark, sf, keep: list[str]):
    return profile.flatten_json(_entries(spark, sf), keep=keep)


def _profile(spark, sf):
    entries = _entries(spark, sf)
    return profile.profile_fields(profile.flatten_json(entries, keep=["id"]),
                                  entries.agg(F.count(F.lit(1))))


@query
def log_type_counts(spark, sf):
    return profile.log_type_counts(_entries(spark, sf))


@query
def flatten_json(spark, sf):
    return _leaves(spark, sf, ["id", "log_type"])


@query
def semantic_types(spark, sf):
    return profile.type_counts(_leaves(spark, sf, []))


@query
def profile_fields(spark, sf):
    return _profile(spark, sf).select("path", "count", "cardinality", "dominant_type", r6("presence_rate").alias("presence_rate"),
                                      joined("samples").alias("samples"))


@query
def merged_profile(spark, sf):
    """Profiles of two halves of the entries, merged without reading them again; is the number of values within four standard errors?"""
    leaves, entries = _leaves(spark, sf, ["id"]), _entries(spark, sf)
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    counts = [materialize(profile.leaf_counts(leaves.where(h)), "leaf-counts") for h in (half, ~half)]
    parts = [materialize(profile.sketch_of_counts(c), "half") for c in counts]
    told = profile.read_profile(profile.merge_profiles(*parts), entries.agg(F.count(F.lit(1))))
    exact = counts[0].unionByName(counts[1]).groupBy("path").agg(F.count_distinct("value").alias("n_values"))
    near = F.abs(F.col("cardinality") - F.col("n_values")) <= F.ceil(F.col("n_values") * (4 * 1.04 / 64))
    return told.join(exact, "path").select("path", "count", "dominant_type", r6("presence_rate").alias("presence_rate"), joined("samples").alias("samples"), "n_values",
                                           near.alias("within_error"))


@query
def timestamp_fields(spark, sf):
    return profile.timestamp_fields(_profile(spark, sf)).select("path")


@query
def actor_target_fields(spark, sf):
    p = _profile(spark, sf)
    return (profile.actor_candidates(p).select("path", "cardinality", F.lit("actor").alias("kind"))
            .unionByName(profile.target_candidates(p).select("path", "cardinality", F.lit("target").alias("kind"))))


@query
def correlation_candidates(spark, sf):
    return profile.correlation_candidates(_profile(spark, sf)).select("path", "score")


def _timed(spark, sf):
    return T.table(spark, sf, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), "ts")


@query
def temporal_clusters(spark, sf):
    c = profile.cluster_sizes(profile.temporal_clusters(_timed(spark, sf), 60.0))
    return c.select(F.unix_micros("cluster_start").alias("cluster_start"), F.unix_micros("cluster_end").alias("cluster_end"),
                    "n_entries")


def _shared(spark, sf):
    return profile.cluster_shared_entries(T.mixed_entries(spark, sf), profile.temporal_clusters(_timed(spark, sf), 60.0))


@query
def cluster_shared(spark, sf):
    return _shared(spark, sf).select(F.unix_micros("cluster_start").alias("cluster_start"), "path", "value")


@query
def cluster_keys(spark, sf):
    return profile.cluster_keys(_shared(spark, sf))


@query
def cross_log_overlap(spark, sf):
    return profile.cross_log_overlap(_leaves(spark, sf, ["log_type"]))


# --- streams ---------------------------------------------------------------------------------------

def _arriving(spark, rows: DataFrame, mark: dict[str, Column], time: str = "ts", most_files: int = 8) -> DataFrame:
    """The rows as a stream of three batches in time order, each of as many files as the smallest can fill.

    A last row far in the future, with the values of ``mark``, moves the watermark past all others.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    lo, hi = rows.agg(F.min(time), F.max(time)).first()
    edges = [lo + (hi - lo) * k / 3 for k in (1, 2)] if lo else []
    piece = sum(((F.col(time) >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    sizes = [r["count"] for r in rows.groupBy(piece.alias("piece")).count().collect()]
    files = max(1, min(most_files, min(sizes, default=0) // 1000)) if len(sizes) == 3 else 1
    for k in range(3):
        rows.where(piece == k).repartition(files).write.mode("append").parquet(folder)
    rows.limit(1).withColumns({time: F.col(time) + F.expr("interval 4000 days")} | mark).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _emitted(spark, out: DataFrame) -> DataFrame:
    """All that a stream emits until its input is used up."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    (out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
     .start(f"{folder}/out", format="parquet", outputMode="append").awaitTermination())
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _streamed(spark, events: DataFrame, form) -> DataFrame:
    last = {"actor_id": F.lit("~"), "event_id": F.lit("~")}
    return _emitted(spark, form(_arriving(spark, events, last)))


@query
def stream_dedup(spark, sf):
    """Every event arrives twice."""
    ev = _events(spark, sf).select("event_id", "ts", "actor_id")
    return _streamed(spark, ev.unionByName(ev), live.dedup_stream).where("actor_id <> '~'").select("event_id", "actor_id")


@query
def stream_actor_windows(spark, sf):
    ev = _events(spark, sf).select("event_id", "ts", "actor_id", "target_id", "action_type")
    out = _streamed(spark, ev, lambda e: live.actor_window_stream(e.withWatermark("ts", live.WATERMARK), DAY)).where("actor_id <> '~'")
    return out.select(*key(), "event_count", "n_targets", joined("action_types").alias("action_types"),
                      r6("burst_per_min").alias("burst_per_min"), r6("breadth_entropy").alias("breadth_entropy"))


@query
def stream_edges(spark, sf):
    ev = _events(spark, sf).select("event_id", "ts", "actor_id", "target_id", "target_zone")
    out = _streamed(spark, ev, lambda e: live.edge_stream(e.withWatermark("ts", live.WATERMARK), DAY)).where("actor_id <> '~'")
    return out.select(*key(), "source_zone", "target_zone", "target_id", "edge_count", F.unix_micros("first_seen").alias("first_seen"))


ENTRIES_PER_FILE = 20_000


@query
def stream_canonical(spark, sf):
    """Raw entries as they arrive, to canonical events."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # A file is one task's to read, and a batch costs a few seconds whatever it reads: many files, in three batches.
    T.raw_entries(spark, sf).select("entry").write.option("maxRecordsPerFile", ENTRIES_PER_FILE).parquet(folder)
    files = len(spark.read.schema("entry string").parquet(folder).inputFiles())
    entries = spark.readStream.schema("entry string").option("maxFilesPerTrigger", max(1, math.ceil(files / 3))).parquet(folder)
    return _emitted(spark, live.canonical_stream(entries)).select(
        "event_id", F.unix_micros("ts").alias("ts"), text("window_start").alias("window_start"), "actor_id", "action_subtype", "target_id", "trigger_ref")


@query
def stream_watches(spark, sf):
    """Every watch with the way it closes first and when: messages and windows of one stream are the input of the next."""
    ev = _events(spark, sf).select("event_id", "ts", "actor_id", "action_type", "target_zone", "target_id")
    last = {"event_id": F.lit("~"), "actor_id": F.lit("~"), "target_id": F.lit("~"), "action_type": F.lit("~"), "target_zone": F.lit("~")}
    messages = _emitted(spark, live.track_watches(_arriving(spark, ev, last), pairs=closure.seed_pairs(spark)))
    windows = ev.select("actor_id", X.floor_window(F.col("ts"), DAY.window_minutes).alias("window_start")).distinct()
    closings = _emitted(spark, live.settle_watches(
        _arriving(spark, messages.select("actor_id", "resource_id", "status", "at"), {"actor_id": F.lit("~"), "resource_id": F.lit("~"), "status": F.lit("OPENED")}, "at"),
        _arriving(spark, windows, {"actor_id": F.lit("~")}, "window_start"), "30 days"))
    opened = messages.where("status = 'OPENED'").select("resource_id", "opening_event_id")
    return opened.join(closings.withColumnRenamed("status", "closed_by"), "resource_id", "left").select(
        "resource_id", "opening_event_id", F.coalesce("closed_by", F.lit("OPEN")).alias("closed_by"), F.unix_micros("at").alias("closed_at"))


@query
def stream_sessions(spark, sf):
    ev = _events(spark, sf).select("event_id", "ts", "actor_id", F.col("event_type").alias("log_type"))
    out = _streamed(spark, ev, lambda e: live.session_clusters(e.where("actor_id <> '~'").unionByName(
        e.where("actor_id = '~'").withColumn("log_type", F.lit("~"))), "10 minutes"))
    return out.where("log_type <> '~'").select("log_type", F.unix_micros("cluster_start").alias("cluster_start"),
                                               F.unix_micros("cluster_end").alias("cluster_end"), "n_entries")


@query
def stream_correlate(spark, sf):
    links = T.request_links(spark, sf).select("service_name", "request_ts", "job_id", "scheduled_time")
    audit = _arriving(spark, T.audit_events(spark, sf), {"actor_id": F.lit("~"), "event_id": F.lit("~")})
    out = _emitted(spark, live.correlate_stream(
        audit, _arriving(spark, links, {"service_name": F.lit("~")}, "request_ts"), T.service_map(spark), WIDE))
    return out.where("actor_id <> '~'").select("event_id", "actor_id", "trigger_ref")


@query
def ingest_twice(spark, sf):
    """The raw entries as files, read once from the start and once from the marks: rows added and stored."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    T.raw_entries(spark, sf).select("entry").write.text(f"{folder}/logs/cloudaudit.googleapis.com/activity")
    spark.read.text(f"{folder}/logs").write.text(f"{folder}/logs/cloudaudit.googleapis.com/activity/again")
    marks, first = {}, []
    for _ in range(2):
        marks, n = raw_logs.ingest_new(spark, f"{folder}/logs", f"{folder}/events", marks, pattern="*.txt")
        first.append(n)
    stored = spark.read.parquet(f"{folder}/events")
    return stored.agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("event_id").alias("ids")).select(
        F.lit(first[0]).cast("long").alias("first_run"), F.lit(first[1]).cast("long").alias("second_run"), "stored", "ids")


@query
def sink_by_day(spark, sf):
    """Windows written by day, the odd days twice: what is stored in the end."""
    w = materialize(world.actor_windows(world.window_activity(world.target_activity(_events(spark, sf)))), "windows")
    folder = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    sinks.write_by_day(w, folder, files_per_day=2)
    sinks.write_by_day(w.where(F.dayofmonth("window_start") % 2 == 1), folder)
    return spark.read.schema(w.schema).parquet(folder).select(*key(), "event_count", "n_targets")


@query
def scan_prefixes(spark, sf):
    """Entries in a folder tree by log, of which two are read."""
    folder = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    logs = {"cloudscheduler.googleapis.com/executions": "signup", "run.googleapis.com/requests": "click", "cloudaudit.googleapis.com/activity": "view"}
    for path, kind in logs.items():
        T.raw_entries(spark, sf).where(F.col("event_type") == kind).select("entry").write.text(f"{folder}/2024/{path}")
    found = raw_logs.scan_logs(spark, folder, list(logs)[:2], pattern="*.txt")
    source = raw_logs.source_of(F.col("source_file"), C.LOG_PREFIXES)
    return found.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))
