"""Actor windows, zone transitions, zone flux and entropy production."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.config import WorldConfig
from flowrisk.functions import expressions as X
from flowrisk.operators.ordered import CROWDED, slice_crowded, with_position, with_previous

WINDOW_KEY = ["window_start", "actor_id"]
EVENT_ORDER = ["ts", "event_id"]


def target_activity(events: DataFrame) -> DataFrame:
    """Counts per (window, actor, target): the first of two aggregation levels.

    Grouping by target first spreads a busy (window, actor) over many tasks and
    leaves the second level little to do.
    """
    action = F.col("action_type")
    is_a = lambda name: (action == name).cast("long")
    return events.groupBy(*WINDOW_KEY, "target_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.bit_or(X.action_bit(action)).alias("action_bits"),
        F.max(_provenance_rank()).alias("provenance_rank"),
        F.sum(((action == "IAM_SET_POLICY") & ~F.coalesce("is_deploy", F.lit(False))).cast("long"))
        .alias("n_policy_no_deploy"),
        F.sum(is_a("IAM_SET_POLICY")).alias("n_policy"),
        F.sum(is_a("IAM_CREATE_KEY")).alias("n_create_key"),
        F.sum(is_a("IAM_IMPERSONATE")).alias("n_impersonate"),
        F.sum(is_a("SECRET_ACCESS")).alias("n_secret"),
        F.sum(is_a("KMS_DECRYPT")).alias("n_decrypt"),
        F.sum(is_a("COMPUTE_METADATA_CHANGE")).alias("n_metadata"),
        F.sum((F.coalesce(F.size("delegation_chain"), F.lit(0)) > 0).cast("long")).alias("n_chained"),
    )


def window_activity(targets: DataFrame) -> DataFrame:
    """Counts per (window, actor) from :func:`target_activity`."""
    summed = ["n_policy_no_deploy", "n_policy", "n_create_key", "n_impersonate", "n_secret",
              "n_decrypt", "n_metadata", "n_chained"]
    hits = F.col("hits").cast("double")
    return targets.groupBy(*WINDOW_KEY).agg(
        F.sum("hits").alias("event_count"),
        F.count(F.lit(1)).alias("n_targets"),
        F.sum(hits * F.log2(hits)).alias("_hlogh"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.bit_or("action_bits").alias("action_bits"),
        F.max("provenance_rank").alias("provenance_rank"),
        *[F.sum(c).alias(c) for c in summed],
    ).withColumn(
        "breadth_entropy",
        F.when(F.col("n_targets") <= 1, F.lit(0.0))
        .otherwise(F.log2(F.col("event_count").cast("double")) - F.col("_hlogh") / F.col("event_count")),
    ).withColumn(
        "burst_per_min",
        F.col("event_count") / F.greatest(
            F.lit(1.0), (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(6e7)),
    ).drop("_hlogh")


def actor_windows(activity: DataFrame) -> DataFrame:
    """Activity table of (window, actor).

    The ordered zone sequence and the set of targets of a window are rows of
    :func:`zone_sequences` and :func:`window_targets`, because either can be far
    larger than one row should be.
    """
    level = F.element_at(F.array(*[F.lit(p) for p in ("NONE", "WEAK", "STRONG")]),
                         F.col("provenance_rank") + 1)
    return activity.select(
        *WINDOW_KEY, "event_count", X.actions_of_bits(F.col("action_bits")).alias("action_types"),
        "n_targets", "burst_per_min", "breadth_entropy", level.alias("provenance_level"))


def window_targets(targets: DataFrame) -> DataFrame:
    """Distinct targets of each (window, actor), one row each."""
    return targets.select(*WINDOW_KEY, "target_id", "hits")


def crowded_windows(activity: DataFrame, most: int = CROWDED) -> DataFrame:
    """(window, actor) with so many events that they have to be cut into slices."""
    return activity.where(F.col("event_count") > most).select(*WINDOW_KEY)


def zone_sequences(events: DataFrame, cfg: WorldConfig = WorldConfig(), crowded: DataFrame | None = None) -> DataFrame:
    """Zones of each (window, actor) in event order, one row per position."""
    return slice_crowded(
        events.select(*WINDOW_KEY, "ts", "event_id", "target_zone"), WINDOW_KEY, _slice(cfg),
        lambda rows, piece: with_position(rows, WINDOW_KEY, EVENT_ORDER, "position", piece), crowded)


def zone_edges(events: DataFrame, cfg: WorldConfig = WorldConfig(), crowded: DataFrame | None = None) -> DataFrame:
    """Transitions between consecutive events of one actor inside one window."""
    moved = slice_crowded(
        events.select(*WINDOW_KEY, "ts", "event_id", "target_zone", "target_id"), WINDOW_KEY, _slice(cfg),
        lambda rows, piece: with_previous(rows, WINDOW_KEY, EVENT_ORDER, {"source_zone": "target_zone"}, piece), crowded)
    return (moved.where(F.col("source_zone").isNotNull())
            .groupBy(*WINDOW_KEY, "source_zone", "target_zone", "target_id")
            .agg(F.count(F.lit(1)).alias("edge_count"), F.min("ts").alias("first_seen")))


def window_rows(events: DataFrame) -> DataFrame:
    """One row per (window, actor): dominant provenance and ``acts``, the zone and target of each event in order.

    For windows whose events fit a row; the others go through :func:`zone_sequences` and :func:`zone_edges`.
    """
    act = F.struct("ts", "event_id", "target_zone", "target_id")
    rows = events.groupBy(*WINDOW_KEY).agg(best_provenance().alias("b"), F.sort_array(F.collect_list(act)).alias("a"))
    return rows.select(*WINDOW_KEY, F.col("b.provenance_level").alias("provenance_level"), F.col("b.trigger_ref").alias("trigger_ref"),
                       F.transform("a", lambda e: F.struct(e["target_zone"].alias("target_zone"), e["target_id"].alias("target_id"))).alias("acts"))


def row_edges(rows: DataFrame) -> DataFrame:
    """Transitions of :func:`window_rows`, as :func:`zone_edges` counts them, without the time."""
    acts = F.col("acts")
    moved = F.transform(acts, lambda e, i: F.struct(F.get(acts, i - 1)["target_zone"].alias("source_zone"), e["target_zone"].alias("target_zone"),
                                                    e["target_id"].alias("target_id")))
    return (rows.where(F.size(acts) > 1).select(*WINDOW_KEY, F.explode(moved).alias("m")).select(*WINDOW_KEY, "m.*").where(F.col("source_zone").isNotNull())
            .groupBy(*WINDOW_KEY, "source_zone", "target_zone", "target_id").agg(F.count(F.lit(1)).alias("edge_count")))


def edge_totals(transitions: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """:func:`edge_novelty` with one row per (window, actor, transition): its events in ``edge_count``, its rows in ``n_targets``.

    Rows are unique, so the flag needs no join; those with a null in the key have none, as there.
    """
    keys = ["actor_id", "source_zone", "target_zone"]
    totals = (transitions.dropna(subset=["window_start", *keys]).groupBy("window_start", *keys)
              .agg(F.sum("edge_count").alias("edge_count"), F.count(F.lit(1)).alias("n_targets")))
    return totals.withColumn("is_new", _unseen(keys, cfg.lookback_seconds))


def _unseen(keys: list[str], seconds: int) -> Column:
    before = F.lag("window_start").over(Window.partitionBy(*keys).orderBy("window_start"))
    gap = F.unix_seconds("window_start") - F.unix_seconds(before)
    return F.coalesce(gap > seconds, F.lit(True))


def mark_new(df: DataFrame, keys: list[str], seconds: int, name: str) -> DataFrame:
    """Distinct (window, key) rows with a flag: key not seen in the lookback before the window.

    The closest earlier window decides, so no self-join is needed.
    """
    seen = df.select("window_start", *keys).distinct()
    return seen.withColumn(name, _unseen(keys, seconds))


def edge_novelty(edges: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """Add ``is_new``: the actor has not made this zone transition in the lookback."""
    keys = ["actor_id", "source_zone", "target_zone"]
    return edges.join(mark_new(edges, keys, cfg.lookback_seconds, "is_new"),
                      ["window_start", *keys])


def novelty_scores(edges: DataFrame) -> DataFrame:
    """Zone-weighted number of new edges per (window, actor); rows of :func:`edge_totals` stand for one edge per target."""
    weight = F.lit(1.0)
    for zone, w in C.ZONE_WEIGHTS.items():
        weight = F.when(F.col("target_zone") == zone, w).otherwise(weight)
    if "n_targets" in edges.columns:
        weight = weight * F.col("n_targets")
    return (edges.where("is_new").groupBy(*WINDOW_KEY).agg(F.sum(weight).alias("novelty_score")))


def bridge_counts(edges: DataFrame) -> DataFrame:
    """New cross-zone transitions of a window, counted once per zone pair."""
    return (edges.where(F.col("is_new") & (F.col("source_zone") != F.col("target_zone")))
            .select("window_start", "source_zone", "target_zone").distinct()
            .groupBy("window_start").agg(F.count(F.lit(1)).alias("bridge_count")))


def flux_cells(edges: DataFrame) -> DataFrame:
    """Non-zero cells (i, j) of each window's zone flux matrix."""
    return (edges.where(F.col("source_zone").isin(C.ZONES) & F.col("target_zone").isin(C.ZONES))
            .groupBy("window_start", "source_zone", "target_zone")
            .agg(F.sum("edge_count").cast("double").alias("flux"))
            .select("window_start", _zone_index("source_zone").alias("i"),
                    _zone_index("target_zone").alias("j"), "flux"))


def flux_pairs(cells: DataFrame) -> DataFrame:
    """Both directions of every zone pair per window, with observations to date.

    At most 21 rows per window, so the running sum over windows is small.
    """
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    both = (cells.groupBy("window_start", lo.alias("lo"), hi.alias("hi"))
            .agg(F.sum(F.when(F.col("i") <= F.col("j"), F.col("flux"))).alias("_up"),
                 F.sum(F.when(F.col("i") > F.col("j"), F.col("flux"))).alias("_down"))
            .select("window_start", "lo", "hi", F.coalesce("_up", F.lit(0.0)).alias("forward"),
                    F.coalesce("_down", F.lit(0.0)).alias("backward")))
    to_date = (Window.partitionBy("lo", "hi").orderBy("window_start")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("observations", F.sum(F.col("forward") + F.col("backward")).over(to_date))


def entropy_production(pairs: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """Entropy production of each window from its reciprocal zone pairs."""
    forward, backward, seen = F.col("forward"), F.col("backward"), F.col("observations")
    trust = (F.when(seen < cfg.cold_observations, 0.0)
             .when(seen <= cfg.warm_observations, 0.5).otherwise(1.0))
    usable = (F.col("lo") != F.col("hi")) & (forward > 0) & (backward > 0)
    return pairs.groupBy("window_start").agg(
        F.coalesce(F.sum(F.when(usable, trust * (forward - backward) * F.log(forward / backward))),
                   F.lit(0.0)).alias("sigma_coarse"))


def zone_flux(windows: DataFrame, edges: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """One row per window: flux matrix, net currents, entropy production, new bridges.

    ``windows`` lists every event window, so that windows without transitions
    keep their place in the baseline.
    """
    cells = flux_cells(edges)
    pairs = flux_pairs(cells)
    net = F.col("forward") - F.col("backward")
    currents = (pairs.where((F.col("lo") != F.col("hi")) & (net != 0)).groupBy("window_start")
                .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
                    F.concat_ws("_", "lo", "hi").alias("key"), net.alias("value"))))).alias("net_currents")))
    size = len(C.ZONES)
    by_cell = (cells.groupBy("window_start").agg(F.map_from_entries(F.collect_list(
        F.struct((F.col("i") * size + F.col("j")).alias("key"), F.col("flux").alias("value")))).alias("_m")))
    matrix = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda j: F.coalesce(F.try_element_at("_m", i * size + j), F.lit(0.0))))
    return (windows.select("window_start").distinct()
            .join(by_cell, "window_start", "left")
            .join(currents, "window_start", "left")
            .join(entropy_production(pairs, cfg), "window_start", "left")
            .join(bridge_counts(edges), "window_start", "left")
            .select("window_start", matrix.alias("flux_matrix"), "net_currents",
                    F.coalesce("sigma_coarse", F.lit(0.0)).alias("sigma_coarse"),
                    F.coalesce("bridge_count", F.lit(0)).alias("bridge_count")))


def ema_delta(flux: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """Entropy production minus its exponential moving average over earlier windows.

    Runs on one row per window. The frame ends where a value weighs less than
    1e-18 under the given alpha, so it gives the full recursion in doubles.
    """
    memory = 1 if cfg.ema_alpha >= 1 else math.ceil(math.log(1e-18) / math.log1p(-cfg.ema_alpha)) + 1
    w = Window.orderBy("window_start").rowsBetween(-memory, -1)
    oldest = F.unix_seconds("window_start") - cfg.ema_days * 86400
    history = F.collect_list(F.struct(F.unix_seconds("window_start").alias("at"),
                                      F.col("sigma_coarse").alias("s"))).over(w)
    recent = F.transform(F.filter("_history", lambda h: h["at"] >= F.col("_oldest")), lambda h: h["s"])
    ema = F.aggregate(F.slice("_recent", 2, F.size("_recent")), F.get("_recent", F.lit(0)),
                      lambda acc, s: s * cfg.ema_alpha + acc * (1 - cfg.ema_alpha))
    return (flux.select("window_start", "sigma_coarse").withColumn("_history", history)
            .withColumn("_oldest", oldest).withColumn("_recent", recent)
            .select("window_start", "sigma_coarse",
                    F.when(F.size("_recent") == 0, 0.0)
                    .otherwise(F.col("sigma_coarse") - ema).alias("delta_f")))


def best_provenance() -> Column:
    """Level and trigger reference of the strongest provenance of a group, earliest first."""
    rank = (F.when(F.col("provenance_level") == "STRONG", -3)
            .when(F.col("provenance_level") == "WEAK", -2).otherwise(-1))
    return F.min(F.struct(rank.alias("r"), F.col("ts"), F.col("event_id"), F.col("provenance_level"), F.col("trigger_ref")))


def _provenance_rank():
    out = F.lit(0)
    for level, rank in C.PROVENANCE_RANK.items():
        out = F.when(F.col("provenance_level") == level, rank).otherwise(out)
    return out


def _zone_index(column: str):
    return (F.array_position(F.array(*[F.lit(z) for z in C.ZONES]), F.col(column)) - 1).cast("int")


def _slice(cfg: WorldConfig):
    """Time slices inside a window, or none where the window is no longer than a slice."""
    return None if cfg.window_minutes <= cfg.slice_minutes else X.time_slice(F.col("ts"), cfg.slice_seconds)
