"""Streaming forms: the same column logic on unbounded input.

Delivery of audit logs can lag by more than an hour, hence the two-hour
watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.config import CorrelationConfig, WorldConfig
from flowrisk.functions import expressions as X
from flowrisk.operators import normalize
from flowrisk.streaming.nearest import NearestRequest
from flowrisk.streaming.watches import settle_watches, track_watches

__all__ = ["actor_window_stream", "canonical_stream", "correlate_stream", "dedup_stream", "edge_stream", "score_batches", "session_clusters",
           "settle_watches", "track_watches"]

WATERMARK = "2 hours"


def canonical_stream(entries: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """Canonical events from a stream of log entries."""
    return normalize.canonicalize_audit(normalize.parse_entries(entries), cfg)


def dedup_stream(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """First arrival of each event id; ids are forgotten once the watermark passes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def actor_window_stream(events: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """Closed actor windows, in two chained aggregations as in the batch form.

    ``events`` carries a watermark on ``ts``.
    """
    span = f"{cfg.window_minutes} minutes"
    by_target = events.groupBy(F.window("ts", span), "actor_id", "target_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.bit_or(X.action_bit(F.col("action_type"))).alias("action_bits"))
    hits = F.col("hits").cast("double")
    out = by_target.groupBy(F.window(F.window_time("window"), span).alias("w"), "actor_id").agg(
        F.sum("hits").alias("event_count"), F.count(F.lit(1)).alias("n_targets"),
        F.sum(hits * F.log2(hits)).alias("_hlogh"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"), F.bit_or("action_bits").alias("action_bits"))
    n = F.col("event_count")
    minutes = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(6e7)
    return out.select(
        F.col("w.start").alias("window_start"), "actor_id", "event_count", "n_targets",
        X.actions_of_bits(F.col("action_bits")).alias("action_types"),
        (n / F.greatest(F.lit(1.0), minutes)).alias("burst_per_min"),
        F.when(F.col("n_targets") <= 1, 0.0).otherwise(F.log2(n.cast("double")) - F.col("_hlogh") / n)
        .alias("breadth_entropy"))


def edge_stream(events: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """Zone transitions of closed windows, as :func:`world.zone_edges` gives them.

    Three chained aggregations: the events of a slice are put in order and turned into its transitions, its first
    and its last event; the slices of a window are stitched together; equal transitions are added up. State
    holds the events of open slices only. ``events`` carries a watermark on ``ts``.
    """
    slice_, span = f"{cfg.slice_minutes} minutes", f"{cfg.window_minutes} minutes"
    if cfg.window_minutes < cfg.slice_minutes:
        slice_ = span
    hop = lambda a, b: F.struct(a["target_zone"].alias("source_zone"), b["target_zone"].alias("target_zone"),
                                b["target_id"].alias("target_id"), b["ts"].alias("at"))
    hops = lambda rows: F.transform(F.sequence(F.lit(1), F.size(rows) - 1, F.lit(1)),
                                    lambda i: hop(F.get(rows, i - 1), F.get(rows, i)))
    row = F.struct("ts", "event_id", "target_zone", "target_id")
    slices = (events.groupBy(F.window("ts", slice_).alias("s"), "actor_id")
              .agg(F.array_sort(F.collect_list(row)).alias("rows")))
    none = F.array().cast("array<struct<source_zone:string,target_zone:string,target_id:string,at:timestamp>>")
    inner = F.when(F.size("rows") > 1, hops(F.col("rows"))).otherwise(none)
    part = F.struct(F.get("rows", F.lit(0)).alias("first"), F.element_at("rows", -1).alias("last"), inner.alias("hops"))
    windows = (slices.select("s", "actor_id", part.alias("part"))
               .groupBy(F.window(F.window_time("s"), span).alias("w"), "actor_id")
               .agg(F.array_sort(F.collect_list("part")).alias("parts")))
    seams = F.when(F.size("parts") > 1, F.transform(
        F.sequence(F.lit(1), F.size("parts") - 1, F.lit(1)),
        lambda i: hop(F.get("parts", i - 1)["last"], F.get("parts", i)["first"]))).otherwise(none)
    every = windows.select("w", "actor_id", F.explode(F.concat(seams, F.flatten(F.transform("parts", lambda p: p["hops"])))).alias("e"))
    edges = every.select("w", "actor_id", "e.*")
    return (edges.groupBy(F.window(F.window_time("w"), span).alias("v"), "actor_id", "source_zone", "target_zone", "target_id")
            .agg(F.count(F.lit(1)).alias("edge_count"), F.min("at").alias("first_seen"))
            .select(F.col("v.start").alias("window_start"), "actor_id", "source_zone", "target_zone", "target_id", "edge_count", "first_seen"))


def session_clusters(timed: DataFrame, gap: str = "30 seconds", delay: str = WATERMARK) -> DataFrame:
    """Bursts of at least two entries per log type."""
    return (timed.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", gap), "log_type").agg(F.count(F.lit(1)).alias("n_entries"))
            .where(F.col("n_entries") >= 2)
            .select("log_type", F.col("session_window.start").alias("cluster_start"),
                    (F.col("session_window.end") - F.expr(f"interval {gap}")).alias("cluster_end"), "n_entries"))


def correlate_stream(audit: DataFrame, links: DataFrame, service_map: DataFrame,
                     cfg: CorrelationConfig = CorrelationConfig(), delay: str = WATERMARK) -> DataFrame:
    """One row per audit event with the trigger reference of the nearest linked request within the tolerance, or null.

    The latest request wins, and among equals the earliest scheduled one, as in the batch form. Time is cut into slices
    as long as the tolerance; requests go to the workers of their service, into their own slice and the next one, where
    they are merged with the events in time order, so that events and requests are never paired.
    """
    workers = service_map.select(F.col("worker").alias("actor_id"), "service_name").distinct()
    width = cfg.audit_seconds * 1_000_000
    slice_ = F.expr(f"unix_micros(ts) div {width}")
    ref = F.concat_ws(":", F.lit("sched"), "job_id", F.unix_seconds("scheduled_time").cast("string"))
    late = F.coalesce(-F.unix_micros("scheduled_time"), F.lit(-(1 << 63)).cast("long"))
    # The watermark comes first, so that requests of services without a worker move it too.
    right = (links.select("service_name", F.col("request_ts").alias("ts"), late.alias("late"), F.when(F.col("job_id").isNotNull(), ref).alias("ref"))
             .withWatermark("ts", delay).join(F.broadcast(workers), "service_name")
             .select("actor_id", "ts", "late", F.lit(None).cast("string").alias("event_id"), "ref", F.lit(False).alias("is_event"))
             .withColumn("slice", F.explode(F.array(slice_, slice_ + 1))))
    left = (audit.select("actor_id", "ts", F.lit(0).cast("long").alias("late"), "event_id", F.lit(None).cast("string").alias("ref"), F.lit(True).alias("is_event"))
            .withWatermark("ts", delay).withColumn("slice", slice_))
    rows = left.unionByName(right).where(F.col("ts").isNotNull()).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("actor_id", "slice").transformWithStateInPandas(
        NearestRequest(width), "event_id string, actor_id string, ts timestamp, trigger_ref string", "append", "EventTime")


# --- scoring per batch ------------------------------------------------------------------

def score_batches(stream: DataFrame, events_path: str, risk_path: str, score):
    """Writer that keeps the risk table up to date with a stream of canonical events.

    Each batch is stored under its own number, so a repeated batch replaces itself, and an event that comes in two
    batches counts once. The first day a batch touches and all later ones are scored again, as averages, novelty and
    watches look back, and overwritten by day. ``score`` maps canonical events to risk rows.
    """
    from flowrisk.sources.sinks import write_by_day

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
        first = spark.read.parquet(f"{events_path}/batch={batch_id}").agg(F.min("window_start")).first()[0]
        if first is None:
            return
        history = normalize.dedup_events(spark.read.parquet(events_path), ["batch"]).drop("batch")
        write_by_day(score(history).where(F.to_date("window_start") >= F.to_date(F.lit(first))), risk_path)

    return stream.writeStream.foreachBatch(run)
