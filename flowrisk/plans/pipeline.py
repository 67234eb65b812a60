"""Events to residual risk in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.config import ClosureConfig, WorldConfig
from flowrisk.functions import expressions as X
from flowrisk.operators import closure, invariants, provenance, scoring, world
from flowrisk.operators.ordered import null_safe_join
from flowrisk.session import materialize, materialize_all


@dataclass(frozen=True)
class WorldModel:
    """The shared tables every signal is built from."""

    events: DataFrame
    targets: DataFrame
    activity: DataFrame
    edges: DataFrame
    watches: DataFrame
    rows: DataFrame
    busy: DataFrame | None
    crowded: DataFrame
    cfg: WorldConfig


#: What the signals read of the events.
EVENT_COLUMNS = [*world.WINDOW_KEY, "ts", "event_id", "action_type", "target_id", "target_zone", "trigger_ref",
                 "provenance_level", "delegation_chain", "is_deploy"]


def build_world(events: DataFrame, pairs: DataFrame, cfg: WorldConfig = WorldConfig(),
                closure_cfg: ClosureConfig = ClosureConfig(), most: int = provenance.CHUNK) -> WorldModel:
    """Reduce the events to the tables that later steps share.

    Each is written once, so the events are not scanned again for every signal. A (window, actor) of at most ``most``
    events is one row that holds its sequence, so provenance, transitions and patterns share one shuffle of the events.
    """
    events = materialize(events.select(*EVENT_COLUMNS), "events")
    targets, opened = materialize_all({
        "targets": world.target_activity(events), "watches": closure.watches(events, pairs, closure_cfg)})
    activity = materialize(world.window_activity(targets), "activity")
    crowded = materialize(world.crowded_windows(activity), "crowded")
    calm, busy = split_busy(events, activity, most)
    rows = materialize(world.window_rows(calm), "rows")
    transitions = world.row_edges(rows)
    if busy is not None:
        transitions = transitions.unionByName(world.zone_edges(busy, cfg, crowded).drop("first_seen"))
    edges = materialize(world.edge_totals(transitions, cfg), "edges")
    return WorldModel(events, targets, activity, edges, opened, rows, busy, crowded, cfg)


def split_busy(events: DataFrame, activity: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Events of windows with at most ``most`` events, which may become a row, and of the others, if there are any.

    The others are at most events / ``most`` windows and so are broadcast.
    """
    many = materialize(world.crowded_windows(activity, most), "busy")
    if many.isEmpty():
        return events, None
    marked = null_safe_join(events, F.broadcast(many.withColumn("_busy", F.lit(True))), world.WINDOW_KEY, "left")
    return tuple(marked.where(c).drop("_busy") for c in (F.col("_busy").isNull(), F.col("_busy").isNotNull()))


def all_pairs(events: DataFrame, seeded: DataFrame, cfg: ClosureConfig = ClosureConfig()) -> DataFrame:
    """Seeded pairs plus those mined from the events."""
    mined = closure.promote_pairs(closure.mine_pairs(events, cfg), seeded, cfg)
    return seeded.unionByName(mined)


def fusion(model: WorldModel, known: DataFrame, pairs: DataFrame,
           closure_cfg: ClosureConfig = ClosureConfig(), point_in_time: bool = True, explain: bool = False) -> DataFrame:
    """Signals and fused score of every (window, actor), with sentences for the fired rules if wanted."""
    cfg, keys = model.cfg, model.activity.select(*world.WINDOW_KEY)
    fired = invariants.check_invariants(model.activity, model.targets, model.edges, known, cfg)
    wanted = {"flux": world.zone_flux(keys, model.edges, cfg),
              "closed": closure.close_times(model.events, model.watches, keys, pairs, closure_cfg)}
    if explain:  # read twice
        wanted["invariants"] = fired
    flux, closed, *written = materialize_all(wanted)
    fired = written[0] if explain else fired
    fused = scoring.fusion_scores(
        model.activity, fired, world.novelty_scores(model.edges), flux, world.ema_delta(flux, cfg),
        closure.closure_signals(closed, keys, cfg, point_in_time))
    if explain:
        fused = scoring.with_explanation(fused, invariants.explain(
            model.events, fired, model.activity, model.edges, model.targets, cfg))
    return fused


def residual(model: WorldModel, fused: DataFrame, known: DataFrame, patterns: DataFrame) -> DataFrame:
    """Fused scores after the provenance discount, with tiers."""
    explained, refs = provenance.row_match(model.rows, patterns).drop("acts"), model.rows.select("trigger_ref")
    if model.busy is not None:
        own = materialize(provenance.dominant_provenance(model.busy), "provenance")
        matches = provenance.pattern_match(model.activity.join(own, world.WINDOW_KEY, "left_semi"),
                                           world.zone_sequences(model.busy, model.cfg, model.crowded), patterns)
        explained = explained.unionByName(own.join(matches, world.WINDOW_KEY, "left"))
        refs = refs.unionByName(own.select("trigger_ref"))
    chains = provenance.trigger_chains(refs, model.events, known)
    return (provenance.discounted(fused, explained, chains)
            .withColumn("tier", X.tier(F.col("residual_risk"), C.RESIDUAL_TIERS)))


def score_events(events: DataFrame, known: DataFrame, patterns: DataFrame, pairs: DataFrame,
                 cfg: WorldConfig = WorldConfig(), closure_cfg: ClosureConfig = ClosureConfig(),
                 point_in_time: bool = True, explain: bool = False, mine: bool = False) -> DataFrame:
    """The whole pipeline: canonical events in, one risk row per (window, actor) out.

    ``mine`` adds the pairs of opening and closing actions that the events themselves show.
    """
    if mine:
        pairs, = materialize_all({"pairs": all_pairs(events, pairs, closure_cfg)})
    model = build_world(events, pairs, cfg, closure_cfg)
    fused = fusion(model, known, pairs, closure_cfg, point_in_time, explain)
    return residual(model, fused, known, patterns)
