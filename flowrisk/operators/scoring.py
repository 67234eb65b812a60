"""Fusion of the signals, risk energy, tiers and suggested actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.functions import expressions as X
from flowrisk.operators.world import WINDOW_KEY


def normalised_signals() -> dict[str, Column]:
    """Signals of a score row, each held to [0, 1]."""
    b = C.FUSION_BOUNDS
    clip = lambda column, signal: X.clip_unit(F.col(column), b[signal])
    return {
        "inv_score": clip("inv_score", "inv_score"),
        "inv_count": clip("inv_count", "inv_count"),
        "novelty_score": clip("novelty_score", "novelty_score"),
        "sigma_coarse": X.sigmoid(F.col("sigma_coarse")),
        "bridge_new": clip("bridge_new", "bridge_new"),
        "delta_f": clip("delta_f", "delta_f"),
        "closure_gap": 1.0 - F.col("closure_ratio"),
        "orphaned_priv": clip("orphaned_privilege", "orphaned_priv"),
        "burst_per_min": clip("burst_per_min", "burst_per_min"),
        "breadth_entropy": clip("breadth_entropy", "breadth_entropy"),
    }


def weighted_sum(weights: dict[str, float]) -> Column:
    signals = normalised_signals()
    return sum((F.lit(w) * signals[name] for name, w in weights.items()), F.lit(0.0))


def fusion_scores(activity: DataFrame, invariants: DataFrame, novelty: DataFrame, flux: DataFrame,
                  delta: DataFrame, closure: DataFrame) -> DataFrame:
    """Signal vector and fused score per (window, actor).

    ``flux`` and ``delta`` have one row per window and are joined on it.
    """
    per_window = (flux.select("window_start", "sigma_coarse", "bridge_count")
                  .join(delta.select("window_start", "delta_f"), "window_start"))
    zero = F.lit(0.0)
    signals = (activity.select(*WINDOW_KEY, "event_count", "burst_per_min", "breadth_entropy")
               .join(invariants.select(*WINDOW_KEY, "inv_score", "inv_count", "fired_invariants"),
                     WINDOW_KEY, "left")
               .join(novelty, WINDOW_KEY, "left")
               .join(closure.select(*WINDOW_KEY, "total_watches", "closed_watches", "closure_ratio",
                                    "orphaned_privilege"), WINDOW_KEY, "left")
               .join(per_window, "window_start", "left")
               .withColumns({
                   "inv_score": F.coalesce("inv_score", zero),
                   "inv_count": F.coalesce("inv_count", F.lit(0)),
                   "novelty_score": F.coalesce("novelty_score", zero),
                   "sigma_coarse": F.coalesce("sigma_coarse", zero),
                   "bridge_new": F.coalesce("bridge_count", F.lit(0)),
                   "delta_f": F.coalesce("delta_f", zero),
                   "closure_ratio": F.coalesce("closure_ratio", F.lit(1.0)),
                   "orphaned_privilege": F.coalesce("orphaned_privilege", zero)}))
    return signals.drop("bridge_count").withColumn("fusion_raw", weighted_sum(C.FUSION_WEIGHTS))


def with_explanation(scores: DataFrame, sentences: DataFrame) -> DataFrame:
    """Add the rule sentences followed by the state of the actor's watches."""
    watched = F.when(F.col("total_watches") > 0, F.format_string(
        "%d of %d open ends closed", "closed_watches", "total_watches"))
    orphaned = F.when((F.col("total_watches") > 0) & (F.col("orphaned_privilege") > 0),
                      F.format_string("%.2f left behind", "orphaned_privilege"))
    return (scores.join(sentences, WINDOW_KEY, "left")
            .withColumn("explanation", F.concat_ws(
                "; ", F.coalesce("explanation", F.lit("no rule fired")), watched, orphaned)))


def risk_energy(scores: DataFrame) -> DataFrame:
    """Energy on a 0-10 scale, raised by open watches, with its alert level."""
    energy = (F.col("residual_risk") * 10.0 * (1.0 + 0.5 * (1.0 - F.col("closure_ratio"))) +
              F.col("orphaned_privilege") / 10.0)
    return (scores.withColumn("risk_energy", energy)
            .withColumn("alert_level", X.tier(F.col("risk_energy"), C.ENERGY_TIERS, inclusive=False)))


def policy_suggestions(energy: DataFrame) -> DataFrame:
    """One suggested action per (window, actor) above the normal level."""
    action = F.element_at(F.create_map(*[F.lit(x) for kv in C.POLICY_ACTIONS.items() for x in kv]),
                          F.col("alert_level"))
    return (energy.where(F.col("alert_level") != "NORMAL")
            .select(F.sha2(F.concat_ws("|", F.unix_seconds("window_start"), "actor_id"), 256)
                    .alias("suggestion_id"),
                    *WINDOW_KEY, "risk_energy", "alert_level", action.alias("suggested_action"),
                    F.format_string("score %.3f, %.3f after discounts; %.2f of open ends closed, %.1f left behind",
                                    "fusion_raw", "residual_risk", "closure_ratio", "orphaned_privilege")
                    .alias("explanation")))
