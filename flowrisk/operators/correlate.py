"""Linking scheduler runs, service requests and audit events in time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.config import CorrelationConfig
from flowrisk.operators.ordered import asof_lookup, nearest_value, null_safe_join, values_at_ranks, with_position, with_previous
from flowrisk.session import materialize

LINK_SCHEMA = "project_id string, scheduler_id string, request_id string, url_match boolean"


def started_runs(schedulers: DataFrame) -> DataFrame:
    return schedulers.where((F.col("attempt_type") == "AttemptStarted") & F.col("scheduled_time").isNotNull())


def link_requests(schedulers: DataFrame, requests: DataFrame,
                  cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """Give each scheduler run its request, one to one, in order of scheduled time.

    A run takes the nearest unused request at most ``link_seconds`` later,
    preferring one with the same URL. Choices depend on earlier ones only while
    runs follow each other within that tolerance, so the runs of a project are
    cut at wider gaps and the islands are matched in parallel. Each is read once
    in time order, with no more in memory than the requests within one tolerance.
    """
    tolerance = cfg.link_seconds * 1_000_000

    def by_slice(at):
        return F.floor(at / F.lit(cfg.slice_seconds * 1_000_000)).cast("long")

    url = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")
    runs = started_runs(schedulers).select(
        "project_id", F.unix_micros("scheduled_time").alias("at"), F.col("insert_id").alias("id"), url("target_url").alias("url"))
    before = with_previous(runs, ["project_id"], ["at", "id"], {"_prev": "at"}, by_slice(F.col("at")))
    fresh = F.col("_prev").isNull() | (F.col("at") - F.col("_prev") >= tolerance)
    runs = materialize(nearest_value(before, ["project_id"], ["at", "id"], F.when(fresh, F.col("at")), "_island",
                                     by_slice(F.col("at")), include_current=True).drop("_prev"), "runs")
    calls = requests.where("is_scheduler_invoked").select(
        "project_id", F.unix_micros("timestamp").alias("at"), F.col("insert_id").alias("id"), url("request_url").alias("url"))
    near = asof_lookup(calls, runs, ["project_id"], "at", "at", ["_island"], "_run", by_slice)
    near = near.where(F.col("at") - F.col("_run.at") < tolerance).select(
        *calls.columns, F.col("_run._island").alias("_island"), F.lit(False).alias("is_run"))
    rows = (runs.withColumn("is_run", F.lit(True)).unionByName(near)
            .select("project_id", "_island", "is_run", "at", "id", "url")
            .repartition("project_id", "_island").sortWithinPartitions("project_id", "_island", "at", "is_run", "id"))
    links = rows.mapInArrow(lambda batches: matched_batches(batches, tolerance), LINK_SCHEMA)

    run_side = started_runs(schedulers).select(
        "project_id", F.col("insert_id").alias("scheduler_id"), "job_id", "scheduled_time")
    call_side = requests.select("project_id", F.col("insert_id").alias("request_id"), "service_name",
                                F.col("timestamp").alias("request_ts"))
    return (null_safe_join(null_safe_join(links, run_side, ["project_id", "scheduler_id"]), call_side, ["project_id", "request_id"]))


class Island:
    """Greedy matching of one island as its rows arrive in time order.

    A run is settled once a row beyond its tolerance arrives. Times of runs only grow, so requests before the
    run to settle are dropped for good, and taken ones are passed over once.
    """

    def __init__(self, tolerance: int):
        self.tolerance, self.runs, self.calls, self.by_url = tolerance, deque(), deque(), {}

    def _first(self, queue: deque, at: int) -> list | None:
        while queue and (queue[0][0] < at or queue[0][2]):
            queue.popleft()
        return queue[0] if queue and queue[0][0] < at + self.tolerance else None

    def settle(self, upto: int | None) -> list[tuple]:
        """Links of all waiting runs whose tolerance ends at or before ``upto``; of all if None."""
        out = []
        while self.runs and (upto is None or self.runs[0][0] + self.tolerance <= upto):
            at, run, url = self.runs.popleft()
            same = self._first(self.by_url[url], at) if url and url in self.by_url else None
            found = same or self._first(self.calls, at)
            if found:
                found[2] = True
                out.append((run, found[1], same is not None))
        return out

    def add(self, is_run: bool, at: int, row: str, url: str) -> list[tuple]:
        out = self.settle(at)
        if is_run:
            self.runs.append((at, row, url))
        else:
            call = [at, row, False]
            for queue in (self.calls, self.by_url.setdefault(url, deque())):
                while queue and queue[0][0] <= at - self.tolerance:  # no waiting run reaches back so far
                    queue.popleft()
                queue.append(call)
        return out


def matched_batches(batches: Iterator[pa.RecordBatch], tolerance: int) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by (project_id, _island, at); see :func:`link_requests`."""
    key, island, out = None, Island(tolerance), []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["project_id", "scheduler_id", "request_id", "url_match"])

    for batch in batches:
        out = []
        for project, start, is_run, at, row, url in zip(*(c.to_pylist() for c in batch.columns)):
            if (project, start) != key:
                if key:
                    out += [(key[0], *x) for x in island.settle(None)]
                key, island = (project, start), Island(tolerance)
            out += [(project, *x) for x in island.add(is_run, at, row, url)]
        yield packed()
    out = [(key[0], *x) for x in island.settle(None)] if key else []
    yield packed()


def cadence(schedulers: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """Upper median of the positive gaps between scheduled times, per project."""
    runs = started_runs(schedulers).select("project_id", "insert_id", F.unix_micros("scheduled_time").alias("at"))
    before = with_previous(runs, ["project_id"], ["at", "insert_id"], {"_prev": "at"},
                           F.floor(F.col("at") / F.lit(86_400_000_000)).cast("long"))
    gaps = before.withColumn("gap", (F.col("at") - F.col("_prev")) / F.lit(1e6)).where("gap > 0")
    middle = values_at_ranks(gaps, ["project_id"], "gap", {"cadence_seconds": F.expr("n div 2")})
    return (runs.select("project_id").distinct().join(middle, "project_id", "left")
            .select("project_id", F.coalesce("cadence_seconds", F.lit(C.DEFAULT_CADENCE_SECONDS))
                    .alias("cadence_seconds")))


def candidate_counts(links: DataFrame, requests: DataFrame,
                     cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """Add to each link how many invoked requests of its service fall in its tolerance, ends included.

    Counted as a difference of positions, so no pairs are formed.
    """
    def by_slice(at):
        return F.floor(at / F.lit(cfg.slice_seconds * 1_000_000)).cast("long")

    calls = requests.where("is_scheduler_invoked").select(
        "service_name", "insert_id", F.unix_micros("timestamp").alias("_at"))
    placed = materialize(
        with_position(calls, ["service_name"], ["_at", "insert_id"], "_pos", by_slice(F.col("_at"))), "placed")
    probe = (links.withColumn("_lo", F.unix_micros("scheduled_time"))
             .withColumn("_hi", F.col("_lo") + cfg.link_seconds * 1_000_000))
    upto = materialize(asof_lookup(probe, placed, ["service_name"], "_hi", "_at", ["_pos"], "_a", by_slice,
                                   tie_order=["_pos"]), "probed")
    both = asof_lookup(upto, placed, ["service_name"], "_lo", "_at", ["_pos"], "_b", by_slice,
                       strict=True, tie_order=["_pos"])
    zero = F.lit(0)
    return both.select(*links.columns, (F.coalesce("_a._pos", zero) - F.coalesce("_b._pos", zero))
                       .alias("candidate_count"))


def confidence(url_match, candidates, gap, cadence_seconds, identity: float = 1.0):
    """Composite confidence of one correlation, to four digits."""
    w = C.CORRELATION_WEIGHTS
    steady = F.when(cadence_seconds > 0, F.greatest(F.lit(0.0), 1.0 - gap / cadence_seconds)).otherwise(0.5)
    total = (w["identity"] * F.lit(identity) + w["url"] * url_match.cast("double") +
             w["ambiguity"] / F.greatest(candidates, F.lit(1)) + w["temporal"] * steady)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)


def correlate_events(audit: DataFrame, links: DataFrame, requests: DataFrame, schedulers: DataFrame,
                     service_map: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """Audit events with the trigger reference of the latest linked request before them.

    ``service_map`` (service_name, worker) is configuration; Spark broadcasts it where it is small.
    Events of other actors pass through with no reference and confidence 0.
    """
    def by_slice(at):
        return F.floor(at / F.lit(cfg.slice_seconds * 1_000_000)).cast("long")

    workers = service_map.groupBy(F.col("worker").alias("actor_id")).agg(F.max("service_name").alias("service_name"))
    named = (audit.drop("trigger_ref", "correlation_confidence")
             .join(workers, "actor_id", "left").withColumn("_us", F.unix_micros("ts")))
    right = (candidate_counts(links, requests, cfg)
             .withColumn("_req", F.unix_micros("request_ts"))
             .withColumn("_late", -F.unix_micros("scheduled_time")))
    cad = cadence(schedulers, cfg)
    right = materialize(right.join(cad, "project_id", "left"), "links")
    values = ["scheduler_id", "request_id", "job_id", "scheduled_time", "url_match", "candidate_count",
              "cadence_seconds"]
    near = asof_lookup(named.where(F.col("service_name").isNotNull()), right, ["service_name"], "_us", "_req",
                       values, "_link", by_slice, tie_order=["_late"])
    gap = (F.col("_us") - F.col("_link.at")) / F.lit(1e6)
    hit = F.col("_link.at").isNotNull() & (gap < cfg.audit_seconds)
    sure = confidence(F.col("_link.url_match"), F.col("_link.candidate_count"), gap,
                      F.coalesce("_link.cadence_seconds", F.lit(C.DEFAULT_CADENCE_SECONDS)))
    ref = F.concat_ws(":", F.lit("sched"), F.col("_link.job_id"),
                      F.unix_seconds("_link.scheduled_time").cast("string"))
    keep = [c for c in named.columns if c not in ("_us", "service_name")]
    found = near.select(
        *keep, F.when(hit, ref).alias("trigger_ref"),
        F.when(hit, sure).otherwise(0.0).alias("correlation_confidence"),
        F.when(hit, F.col("_link.scheduler_id")).alias("scheduler_id"),
        F.when(hit, F.col("_link.request_id")).alias("request_id"))
    rest = named.where(F.col("service_name").isNull()).select(
        *keep, F.lit(None).cast("string").alias("trigger_ref"), F.lit(0.0).alias("correlation_confidence"),
        F.lit(None).cast("string").alias("scheduler_id"), F.lit(None).cast("string").alias("request_id"))
    return found.unionByName(rest)


def observed_workers(links: DataFrame, audit: DataFrame,
                     cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """Audit events per (service, actor) in the time after each linked request, ends included.

    An event counts once for every request of the service that it follows
    closely enough. For each service active around the event that number is a
    difference of request positions, so events and requests are never paired.
    """
    width = cfg.audit_seconds * 1_000_000
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    calls = links.select("service_name", F.unix_micros("request_ts").alias("_r"),
                         F.monotonically_increasing_id().alias("_id"))
    placed = materialize(with_position(calls, ["service_name"], ["_r", "_id"], "_pos", bucket(F.col("_r"))), "placed")
    active = (placed.select("service_name", F.explode(F.array(bucket(F.col("_r")), bucket(F.col("_r")) + 1)).alias("_b"))
              .distinct())
    seen = (audit.groupBy("actor_id", F.unix_micros("ts").alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_b", bucket(F.col("_e"))).join(active, "_b").drop("_b")
            .withColumn("_from", F.col("_e") - width))
    upto = materialize(asof_lookup(seen, placed, ["service_name"], "_e", "_r", ["_pos"], "_a", bucket,
                                   tie_order=["_pos"]), "probed")
    both = asof_lookup(upto, placed, ["service_name"], "_from", "_r", ["_pos"], "_b", bucket, strict=True,
                       tie_order=["_pos"])
    near = F.coalesce("_a._pos", F.lit(0)) - F.coalesce("_b._pos", F.lit(0))
    return (both.withColumn("_near", near).where(F.col("_near") > 0)
            .groupBy("service_name", "actor_id").agg(F.sum(F.col("_n") * F.col("_near")).alias("n_events")))


def validate_service_map(links: DataFrame, audit: DataFrame, service_map: DataFrame,
                         cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """Configured worker against the most active account of each service."""
    top = (observed_workers(links, audit, cfg).groupBy("service_name")
           .agg(F.min(F.struct((-F.col("n_events")).alias("n"), "actor_id")).alias("t"))
           .select("service_name", F.col("t.actor_id").alias("observed_worker"),
                   (-F.col("t.n")).alias("n_events")))
    both = top.join(service_map.select("service_name", F.col("worker").alias("configured_worker")),
                    "service_name", "full_outer")
    status = (F.when(F.col("observed_worker").isNull(), "unobserved")
              .when(F.col("configured_worker").isNull(), "discovered")
              .when(F.col("configured_worker") == F.col("observed_worker"), "confirmed")
              .otherwise("mismatched"))
    return both.select("service_name", "configured_worker", "observed_worker",
                       F.coalesce("n_events", F.lit(0)).alias("n_events"), status.alias("status"))


def hydration_summary(validated: DataFrame) -> DataFrame:
    """One row: is every configured service confirmed by observation?"""
    configured = F.count("configured_worker")
    confirmed = F.count(F.when(F.col("status") == "confirmed", 1))
    mismatched = F.count(F.when(F.col("status") == "mismatched", 1))
    least = F.min("n_events")
    return validated.agg(
        configured.alias("configured"), confirmed.alias("confirmed"), mismatched.alias("mismatched"),
        F.coalesce(least, F.lit(0)).alias("min_observations"),
        ((configured > 0) & (confirmed == configured) & (mismatched == 0) &
         (F.coalesce(least, F.lit(0)) > 0)).alias("hydration_complete"))
