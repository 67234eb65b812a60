"""Open/close tracking of privileged changes: watches, closings, signals, pair mining."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrisk.config import ClosureConfig, WorldConfig
from flowrisk.functions import expressions as X
from flowrisk.operators.ordered import CROWDED, asof_lookup, nearest_value, values_at_ranks
from flowrisk.operators.world import WINDOW_KEY
from flowrisk.session import materialize

HOUR = 3600
# Openings are grouped in cells of this share of the watch length; with six
# moments per cell the series below is exact to double precision.
CELLS_PER_WINDOW = 64
MOMENTS = 6


def seed_pairs(spark: SparkSession, cfg: ClosureConfig = ClosureConfig()) -> DataFrame:
    """Configured opening and closing pairs."""
    return spark.createDataFrame(
        [tuple(p) for p in cfg.pairs],
        "pair_id string, opening_action_type string, closing_action_type string, "
        "window_hours int, tier int")


def _lookup(table: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def watches(events: DataFrame, pairs: DataFrame, cfg: ClosureConfig = ClosureConfig()) -> DataFrame:
    """One watch per resource: its first opening event ever.

    ``pairs`` has at most one row per pair of action types, so it is small
    whatever the event volume and is broadcast.
    """
    by_opening = (pairs.groupBy("opening_action_type")
                  .agg(F.min(F.struct("tier", "pair_id", "closing_action_type", "window_hours")).alias("_p"))
                  .select(F.col("opening_action_type").alias("action_type"), "_p"))
    action = F.col("action_type")
    opening = (action.isin(*cfg.opening_types) | F.col("_p").isNotNull() |
               F.col("target_zone").isin(*cfg.failsafe_zones))
    first = (events.select("ts", "event_id", "actor_id", "action_type", "target_zone", "target_id")
             .join(F.broadcast(by_opening), "action_type", "left").where(opening)
             .groupBy("target_id")
             .agg(F.min(F.struct("ts", "event_id", "actor_id", "action_type", "_p")).alias("o")))
    act = F.col("o.action_type")
    kind = _lookup(cfg.resource_types, act, "UNKNOWN")
    ttl = _lookup(cfg.temporal_ttl, act, None).cast("int")
    default_sensitivity = cfg.sensitivity.get("UNKNOWN", 3.0)
    return (first.select(
        F.col("target_id").alias("resource_id"), kind.alias("resource_type"),
        F.col("o.event_id").alias("opening_event_id"), F.col("o.ts").alias("opening_ts"),
        F.col("o.actor_id").alias("opening_actor_id"), act.alias("opening_action_type"),
        F.coalesce(F.col("o._p.closing_action_type"),
                   F.when(ttl.isNotNull(), "TEMPORAL_EXPIRY"), F.lit("SETTLEMENT")).alias("expected_close_type"),
        F.coalesce(F.col("o._p.window_hours"), ttl,
                   _lookup(cfg.settlement_hours, kind, cfg.default_window_hours)).alias("window_hours"),
        _lookup(cfg.sensitivity, kind, default_sensitivity).alias("sensitivity")))


def explicit_closings(events: DataFrame, opened: DataFrame, pairs: DataFrame) -> DataFrame:
    """Earliest closing event of each watch: (resource_id, closing_ts, closing_event_id).

    An event closes a watch when its action is the one expected. A watch whose
    expected type no pair knows is also closed by any closing action that
    ``pairs`` (which may have grown since) lists for its opening action.
    """
    known = pairs.groupBy(F.col("closing_action_type").alias("action_type")).agg(
        F.collect_set("opening_action_type").alias("_openings"))
    closers = (events.select("ts", "event_id", "action_type", F.col("target_id").alias("resource_id"))
               .join(F.broadcast(known), "action_type"))
    expected = opened.join(F.broadcast(known.select(F.col("action_type").alias("expected_close_type"),
                                                    F.lit(True).alias("_is_pair"))),
                           "expected_close_type", "left")
    hit = ((F.col("action_type") == F.col("expected_close_type")) |
           (F.col("_is_pair").isNull() & F.array_contains("_openings", F.col("opening_action_type"))))
    later = F.struct("ts", "event_id") > F.struct(F.col("opening_ts"), F.col("opening_event_id"))
    return (closers.join(expected, "resource_id").where(hit & later)
            .groupBy("resource_id").agg(F.min(F.struct("ts", "event_id")).alias("c"))
            .select("resource_id", F.col("c.ts").alias("closing_ts"),
                    F.col("c.event_id").alias("closing_event_id")))


def settlements(events: DataFrame, opened: DataFrame, windows: DataFrame,
                cfg: ClosureConfig = ClosureConfig()) -> DataFrame:
    """First window of the opening actor at which a resource has been quiet long enough.

    A watch settles at window W when W is at least ``s`` hours past both the
    opening and the last activity up to W. Activity is first reduced to its
    ends per (resource, short slice): gaps inside a slice are too short to
    settle anything, so what is left per resource is bounded by the calendar.
    """
    width = 900
    quiet = _lookup({k: v * HOUR for k, v in cfg.settlement_hours.items()}, F.col("resource_type"),
                    cfg.default_settlement_hours * HOUR)
    if min([*cfg.settlement_hours.values(), cfg.default_settlement_hours]) * HOUR < width:
        raise ValueError("settlement times must not be shorter than the activity slice")
    settleable = (opened.where(~F.col("resource_type").isin(*cfg.never_settle))
                  .select("resource_id", F.col("opening_actor_id").alias("actor_id"),
                          X.time_slice(F.col("opening_ts"), width).alias("_from"),
                          quiet.alias("_quiet")))
    bursts = (events.groupBy(F.col("target_id").alias("resource_id"),
                             X.time_slice(F.col("ts"), width).alias("_slice_no"))
              .agg(F.min("ts").alias("_first"), F.max("ts").alias("_last")))
    per_resource = Window.partitionBy("resource_id").orderBy("_slice_no")
    gaps = (bursts.withColumn("_next", F.lead("_first").over(per_resource))
            .join(settleable, "resource_id").where(F.col("_slice_no") >= F.col("_from"))
            .select("resource_id", "actor_id",
                    (F.unix_micros("_last") + F.col("_quiet").cast("long") * 1_000_000).alias("_settled_at"),
                    F.unix_micros("_next").alias("_until"))
            .where(F.col("_until").isNull() | (F.col("_until") > F.col("_settled_at"))))
    at = (windows.select("actor_id", F.unix_micros("window_start").alias("_window")).distinct())
    day = lambda micros: F.floor(micros / F.lit(86_400_000_000)).cast("long")
    found = asof_lookup(materialize(gaps, "gaps"), at, ["actor_id"], "_settled_at", "_window", [], "_w", day, forward=True, most=CROWDED)
    reached = F.col("_w.at")
    return (found.where(reached.isNotNull() & (F.col("_until").isNull() | (reached < F.col("_until"))))
            .groupBy("resource_id").agg(F.timestamp_micros(F.min(reached)).alias("settled_ts")))


def close_times(events: DataFrame, opened: DataFrame, windows: DataFrame, pairs: DataFrame,
                cfg: ClosureConfig = ClosureConfig()) -> DataFrame:
    """Watches with the times at which each way of closing takes effect."""
    expiry = F.when(F.col("expected_close_type") == "TEMPORAL_EXPIRY",
                    F.timestamp_micros(F.unix_micros("opening_ts") +
                                       F.col("window_hours").cast("long") * (HOUR * 1_000_000)))
    return (opened.withColumn("expiry_ts", expiry)
            .join(explicit_closings(events, opened, pairs), "resource_id", "left")
            .join(settlements(events, opened, windows, cfg), "resource_id", "left"))


def closure_signals(closed: DataFrame, windows: DataFrame, world: WorldConfig = WorldConfig(),
                    point_in_time: bool = True) -> DataFrame:
    """Share of closed watches and overdue weight per (window, actor).

    With ``point_in_time`` a window knows only what happened up to it. Without
    it, openings and explicit closings of all times count, as in a run that
    ingests everything before it scores anything.

    Neither signal pairs windows with watches. Counts are running sums on the
    window grid. The overdue weight of a watch, s * (1 + log2(age / length)),
    is summed over groups of watches opened close together from power sums of
    their offsets (see ``_overdue``).
    """
    step = world.window_seconds
    up = lambda ts: F.ceil(F.unix_micros(ts) / F.lit(step * 1_000_000)).cast("long")
    seen_at = up("opening_ts") if point_in_time else F.lit(-(1 << 40)).cast("long")
    explicit_at = F.when(F.col("closing_ts").isNotNull(),
                         up("closing_ts") if point_in_time else F.lit(-(1 << 40)).cast("long"))
    grid = closed.select(
        F.col("opening_actor_id").alias("actor_id"), "sensitivity", "window_hours",
        (F.unix_micros("opening_ts") / F.lit(1e6)).alias("opened"), seen_at.alias("seen_at"),
        F.least(explicit_at, up("expiry_ts"), up("settled_ts")).alias("closed_at"))

    moves = (grid.select("actor_id", F.explode(F.array(
        F.struct(F.col("seen_at").alias("at"), F.lit(1).alias("opened_n"), F.lit(0).alias("closed_n")),
        F.struct(F.when(F.col("closed_at").isNotNull(), F.greatest("closed_at", "seen_at")).alias("at"),
                 F.lit(0).alias("opened_n"), F.lit(1).alias("closed_n")))).alias("m")).select("actor_id", "m.*")
             .where(F.col("at").isNotNull())
             .groupBy("actor_id", "at").agg(F.sum("opened_n").alias("opened_n"),
                                            F.sum("closed_n").alias("closed_n")))
    keys = windows.select(*WINDOW_KEY).distinct().withColumn("at", F.expr(
        f"unix_seconds(window_start) div {step}"))
    # One row per (actor, grid step): bounded by the calendar, not by the data.
    so_far = (Window.partitionBy("actor_id").orderBy("at")
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = (moves.unionByName(keys.withColumn("_is_window", F.lit(True)), allowMissingColumns=True)
               .withColumn("total_watches", F.coalesce(F.sum("opened_n").over(so_far), F.lit(0)))
               .withColumn("closed_watches", F.coalesce(F.sum("closed_n").over(so_far), F.lit(0)))
               .where(F.col("_is_window")).select(*WINDOW_KEY, "total_watches", "closed_watches"))
    overdue = _overdue(grid, keys, step)
    return (counted.join(overdue, WINDOW_KEY, "left")
            .select(*WINDOW_KEY, "total_watches", "closed_watches",
                    F.when(F.col("total_watches") == 0, 1.0)
                    .otherwise(F.col("closed_watches") / F.col("total_watches")).alias("closure_ratio"),
                    F.coalesce("orphaned_privilege", F.lit(0.0)).alias("orphaned_privilege")))


def _overdue(grid: DataFrame, keys: DataFrame, step: int) -> DataFrame:
    """Sum of s * (1 + log2((W - o) / h)) over open watches older than their length h.

    Watches of one actor and kind whose openings o fall into one cell of width
    h / 64 around c are merged. With X = (W - c) / h and d = (o - c) / h,
    ln((W - o) / h) = ln X - sum_k (d / X)^k / k, and |d / X| < 1 / 126, so six
    power sums of d per group give the sum to double precision.
    """
    length = F.col("window_hours") * F.lit(float(HOUR))
    cell = length / CELLS_PER_WINDOW
    first = (F.floor((F.col("opened") + length) / F.lit(float(step))) + 1).cast("long")
    live = (grid.withColumn("_from", F.greatest(first, "seen_at"))
            .withColumn("_to", F.coalesce(F.col("closed_at") - 1, F.lit(1 << 40)))
            .where(F.col("_from") <= F.col("_to"))
            .withColumn("_cell", F.floor(F.col("opened") / cell).cast("long"))
            .withColumn("_centre", (F.col("_cell") + 0.5) * cell)
            .withColumn("_d", (F.col("opened") - F.col("_centre")) / length))
    groups = live.groupBy("actor_id", "sensitivity", "window_hours", "_cell", "_centre", "_from", "_to").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.pow("_d", F.lit(k))).alias(f"_m{k}") for k in range(1, MOMENTS + 1)])

    # Both sides meet per (actor, day-sized span of the grid) they share.
    per_span = max(1, 86400 // step)
    ends = keys.groupBy("actor_id").agg(F.max("at").alias("_end"), F.min("at").alias("_begin"))
    spans = (groups.join(ends, "actor_id")
             .withColumn("_from", F.greatest("_from", "_begin"))
             .withColumn("_to", F.least("_to", "_end")).where(F.col("_from") <= F.col("_to"))
             .withColumn("_span", F.explode(F.sequence(F.floor(F.col("_from") / per_span),
                                                       F.floor(F.col("_to") / per_span)))))
    at_key = keys.withColumn("_span", F.floor(F.col("at") / per_span))
    x = (F.col("at") * F.lit(float(step)) - F.col("_centre")) / (F.col("window_hours") * F.lit(float(HOUR)))
    series = F.lit(0.0)
    for k in range(MOMENTS, 0, -1):
        series = (series + F.col(f"_m{k}") / F.lit(float(k))) / F.col("_x")
    logs = (F.col("_n") * F.log("_x") - series) / F.lit(math.log(2))
    return (at_key.join(spans, ["actor_id", "_span"])
            .where((F.col("at") >= F.col("_from")) & (F.col("at") <= F.col("_to"))).withColumn("_x", x)
            .groupBy(*WINDOW_KEY)
            .agg(F.sum(F.col("sensitivity") * (F.col("_n") + logs)).alias("orphaned_privilege")))


def mine_pairs(events: DataFrame, cfg: ClosureConfig = ClosureConfig(),
               slice_seconds: int = 86400) -> DataFrame:
    """Recurring (action, next different action) sequences on sensitive resources."""
    zones = sorted({*cfg.failsafe_zones, *cfg.mining_extra_zones})
    order = ["ts", "event_id"]
    slice_by = X.time_slice(F.col("ts"), slice_seconds)
    rows = (events.where(F.col("target_zone").isin(zones))
            .select("target_id", "ts", "event_id", "action_type"))
    before = materialize(nearest_value(rows, ["target_id"], order, F.col("action_type"), "_prev", slice_by), "runs")
    # A run starts where the action changes; every event looks for the next run.
    start = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("action_type")),
                   F.struct("ts", "action_type"))
    ahead = nearest_value(before, ["target_id"], order, start, "_next", slice_by, forward=True)
    gap = (F.unix_micros(F.col("_next.ts")) - F.unix_micros("ts")) / F.lit(3.6e9)
    found = (ahead.where(F.col("_next").isNotNull())
             .select(F.col("action_type").alias("opening_action_type"),
                     F.col("_next.action_type").alias("closing_action_type"), gap.alias("gap_hours"))
             .where(F.col("gap_hours") <= cfg.max_gap_hours))
    keys = ["opening_action_type", "closing_action_type"]
    middle = values_at_ranks(materialize(found, "gaps"), keys, "gap_hours", {"median_gap_hours": F.expr("n div 2")})
    return (middle.where(F.col("n") >= cfg.min_observations)
            .select(F.concat_ws("-", F.lit("cp"), *keys).alias("candidate_id"), *keys,
                    F.col("n").alias("obs_count"), "median_gap_hours"))


def promote_pairs(candidates: DataFrame, pairs: DataFrame,
                  cfg: ClosureConfig = ClosureConfig()) -> DataFrame:
    """Candidates seen often enough, as tier-2 pairs, unless the pair exists already."""
    hours = F.greatest(F.lit(1), (F.bround("median_gap_hours", 1) * 2).cast("int"))
    fresh = candidates.where(F.col("obs_count") >= cfg.promote_observations)
    known = pairs.select("opening_action_type", "closing_action_type").distinct()
    return (fresh.join(F.broadcast(known), ["opening_action_type", "closing_action_type"], "left_anti")
            .select(F.concat_ws("-", F.lit("disc"), "opening_action_type", "closing_action_type")
                    .alias("pair_id"),
                    "opening_action_type", "closing_action_type", hours.alias("window_hours"),
                    F.lit(2).alias("tier")))


def candidate_status(candidates: DataFrame, pairs: DataFrame,
                     cfg: ClosureConfig = ClosureConfig()) -> DataFrame:
    """Candidates with what became of them: ``existing``, the id of the new pair, or null."""
    known = (pairs.select("opening_action_type", "closing_action_type").distinct()
             .withColumn("_known", F.lit(True)))
    fresh = F.concat_ws("-", F.lit("disc"), "opening_action_type", "closing_action_type")
    return (candidates.join(F.broadcast(known), ["opening_action_type", "closing_action_type"], "left")
            .select(*candidates.columns, F.when(
                F.col("obs_count") >= cfg.promote_observations,
                F.when(F.col("_known"), F.lit("existing")).otherwise(fresh)).alias("promoted_to")))
