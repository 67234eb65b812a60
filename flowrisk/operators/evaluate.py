"""Ablation, sweeps, detection rates and alert-budget evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.functions import expressions as X
from flowrisk.operators.ordered import asof_lookup, linear_percentiles, null_safe_join, values_at_ranks
from flowrisk.operators.scoring import normalised_signals, weighted_sum
from flowrisk.operators.world import WINDOW_KEY
from flowrisk.session import materialize


# --- ablation ------------------------------------------------------------------

def reweight(weights: dict[str, float], zeroed: list[str], mode: str) -> dict[str, float]:
    """Weights without some signals: ``zero`` scales the rest to one, ``redistribute`` shares out."""
    kept = sum(w for s, w in weights.items() if s not in zeroed)
    gone = sum(weights[s] for s in zeroed)
    if kept == 0:
        return {s: 0.0 if s in zeroed else w for s, w in weights.items()}
    factor = {"zero": 1.0 / kept, "redistribute": 1.0 + gone / kept}[mode]
    return {s: 0.0 if s in zeroed else w * factor for s, w in weights.items()}


def ablated_sum(weights: dict[str, float], zeroed: list[str], mode: str) -> Column:
    """Fusion under the weights of :func:`reweight`.

    The signals that stay are summed first and scaled once: scaled weights are rounded each, and a score that
    lies exactly on a tier's bound would fall under it.
    """
    kept = math.fsum(w for s, w in weights.items() if s not in zeroed)
    if kept == 0:
        return weighted_sum(reweight(weights, zeroed, mode))
    total = {"zero": 1.0, "redistribute": math.fsum(weights.values())}[mode]
    rest = weighted_sum({s: 0.0 if s in zeroed else w for s, w in weights.items()})
    return rest * F.lit(total) / F.lit(kept)


def ablate(scores: DataFrame, zeroed: list[str], mode: str) -> DataFrame:
    """Fusion under changed weights, with its difference and both tiers."""
    return (scores.withColumn("ablated", ablated_sum(C.FUSION_WEIGHTS, zeroed, mode))
            .withColumn("delta", F.col("ablated") - F.col("fusion_raw"))
            .withColumn("old_tier", X.tier(F.col("fusion_raw"), C.FUSION_TIERS))
            .withColumn("new_tier", X.tier(F.col("ablated"), C.FUSION_TIERS)))


def tier_migration(ablated: DataFrame) -> DataFrame:
    return ablated.groupBy("old_tier", "new_tier").agg(F.count(F.lit(1)).alias("n"))


def ablation_stats(ablated: DataFrame) -> DataFrame:
    """Mean, median, standard deviation and maximum of the absolute difference."""
    size = ablated.withColumn("d", F.abs("delta"))
    flat = size.agg(F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("stdev"),
                    F.max("d").alias("max"))
    return flat.join(F.broadcast(linear_percentiles(size, [], "d", {"median": 0.5})), F.lit(True))


def ablation_top(ablated: DataFrame, n: int = 10) -> DataFrame:
    """Rows moved most, with the three signals that weigh most in them."""
    parts = [F.struct((-F.lit(w) * normalised_signals()[s]).alias("v"), F.lit(i).alias("i"), F.lit(s).alias("s"))
             for i, (s, w) in enumerate(C.FUSION_WEIGHTS.items()) if w > 0]
    top = F.transform(F.slice(F.array_sort(F.array(*parts)), 1, 3), lambda p: p["s"])
    return (ablated.orderBy(F.abs(F.col("delta")).desc(), *WINDOW_KEY).limit(n)
            .select(*WINDOW_KEY, "fusion_raw", "ablated", "delta", "old_tier", "new_tier",
                    top.alias("dominant_signals")))


def role_stats(scores: DataFrame, zeroed: list[str], reference_role: str = "worker",
               role: Column | None = None) -> DataFrame:
    """Ablation effect per role, and each role's mean against the reference role's."""
    role = X.role_of(F.col("actor_id")) if role is None else role
    z = ablated_sum(C.FUSION_WEIGHTS, zeroed, "zero")
    d = ablated_sum(C.FUSION_WEIGHTS, zeroed, "redistribute")
    t = lambda c: X.tier(F.col(c), C.FUSION_TIERS)
    rows = scores.select("*", role.alias("role"), z.alias("zero"), d.alias("redist"))
    share = lambda c: F.avg(c.cast("double")) * 100.0
    moved = lambda c: F.sum((t("fusion_raw") != t(c)).cast("long"))
    per = rows.groupBy("role").agg(
        F.count(F.lit(1)).alias("count"),
        *[x for name, c in (("baseline", "fusion_raw"), ("zero", "zero"), ("redist", "redist"))
          for x in (F.avg(c).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{name}_stdev"))],
        share((1.0 - F.col("closure_ratio")) > 0.001).alias("closure_gap_active_pct"),
        share(F.col("orphaned_privilege") > 0.001).alias("orphaned_priv_active_pct"),
        moved("zero").alias("tier_changes_zero"), moved("redist").alias("tier_changes_redist"))
    # At most one row, so it is broadcast.
    base = per.where(F.col("role") == reference_role).select(
        *[F.col(f"{n}_mean").alias(f"_{n}") for n in ("baseline", "zero", "redist")])
    gap = lambda n: F.when(F.col("_baseline") > 0, F.when(
        F.col(f"_{n}") > 0, F.col(f"{n}_mean") / F.col(f"_{n}"))).alias(f"gap_{n}")
    return (per.join(F.broadcast(base), F.lit(True), "left")
            .select(*per.columns, gap("baseline"), gap("zero"), gap("redist")))


# --- scenario and run summaries -----------------------------------------------

def scenario_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Highest and mean residual, worst tier and all rules fired, per scenario."""
    worst = F.max(F.struct(X.tier_rank(F.col("tier")).alias("r"), F.col("tier")))
    fired = F.array_compact(F.array(*[
        F.when(F.bool_or(F.array_contains("fired_invariants", r)), F.lit(r)) for r in sorted(C.INVARIANT_SEVERITY)]))
    return scores.groupBy(*keys).agg(
        F.max("residual_risk").alias("max_residual"), F.avg("residual_risk").alias("mean_residual"),
        worst["tier"].alias("max_tier"), fired.alias("fired_invariants"), F.count(F.lit(1)).alias("n_pairs"))


def role_gap(scores: DataFrame, keys: list[str], is_attacker: Column, is_worker: Column) -> DataFrame:
    """Attacker against worker residual: gap in percent, false positive and false negative rate."""
    high = F.col("tier").isin("MEDIUM", "HIGH")
    per_actor = (scores.withColumn("_att", is_attacker).withColumn("_wrk", is_worker & ~is_attacker)
                 .groupBy(*keys, "actor_id", "_att", "_wrk")
                 .agg(F.avg("residual_risk").alias("_mean"), F.count(F.lit(1)).alias("_n"),
                      F.sum(high.cast("long")).alias("_high")))
    mean = lambda flag: F.coalesce(F.avg(F.when(F.col(flag), F.col("_mean"))), F.lit(0.0))
    rate = lambda hit, flag: F.coalesce(
        F.sum(F.when(F.col(flag), hit)) / F.sum(F.when(F.col(flag), F.col("_n"))), F.lit(0.0))
    out = per_actor.groupBy(*keys).agg(
        mean("_att").alias("attacker_mean"), mean("_wrk").alias("worker_mean"),
        rate(F.col("_high"), "_wrk").alias("fp_rate"),
        rate(F.col("_n") - F.col("_high"), "_att").alias("fn_rate"))
    a, w = F.col("attacker_mean"), F.col("worker_mean")
    return out.withColumn("gap_pct", F.when(w > 0, (a - w) / w * 100.0).when(a > 0, 100.0).otherwise(0.0))


def signal_activation(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Share of scored rows on which each signal is active."""
    on = lambda c: F.avg(c.cast("double"))
    return scores.groupBy(*keys).agg(
        on(F.col("inv_score") > 0).alias("inv_score"), on(F.col("novelty_score") > 0).alias("novelty_score"),
        on(F.col("bridge_new") > 0).alias("bridge_new"), on(F.col("closure_ratio") < 1).alias("closure_gap"),
        on(F.col("orphaned_privilege") > 0).alias("orphaned_priv"),
        on(F.col("trigger_chain_resolved")).alias("trigger_resolved"))


def signal_reliability(activations: DataFrame, signals: list[str]) -> DataFrame:
    """Per signal the share of runs in which it is ever active, and its mean activation; one row per run in."""
    cells = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in signals])
    return (activations.select(F.explode(cells).alias("c")).groupBy("c.signal")
            .agg(F.avg((F.col("c.v") > 0).cast("double")).alias("reliability"), F.avg("c.v").alias("mean_activation")))


def sweep_report(runs: DataFrame, value: str, axes: list[str]) -> DataFrame:
    """Mean, spread, range and median of a run metric overall and along each axis alone."""
    sets = _one_axis_at_a_time(runs.select(value, *axes), axes)
    flat = sets.groupBy("axis", "level").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    middle = linear_percentiles(sets, ["axis", "level"], value, {"median": 0.5}).drop("n")
    return null_safe_join(flat, middle, ["axis", "level"])


def _one_axis_at_a_time(rows: DataFrame, axes: list[str]) -> DataFrame:
    """Each row once per grouping set (), (axis 1), (axis 2), ..."""
    sets = [F.struct(F.lit("overall").alias("axis"), F.lit("all").alias("level"))]
    sets += [F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in axes]
    keep = [c for c in rows.columns if c not in axes]
    return rows.select(*keep, F.explode(F.array(*sets)).alias("_s")).select(*keep, "_s.axis", "_s.level")


def detection_by_axis(results: DataFrame, axes: list[str], detected: Column) -> DataFrame:
    """Detection rate overall and for every level of every axis, with the gate verdict."""
    rows = _one_axis_at_a_time(results.select(detected.cast("double").alias("_d"), *axes), axes)
    rates = rows.groupBy("axis", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("rate"))
    # One row per axis level: a short report.
    whole = Window.partitionBy()
    overall = F.max(F.when(F.col("axis") == "overall", F.col("rate"))).over(whole)
    wiped = F.max((F.col("rate") == 0).cast("int")).over(whole) == 1
    verdict = (F.when((overall >= C.GATE_PASS) & ~wiped, "PASS").when(overall >= C.GATE_PASS, "CLASS-WIPE")
               .when(overall >= C.GATE_BORDERLINE, "BORDERLINE").otherwise("FAIL"))
    return rates.withColumn("verdict", verdict)


def signal_max(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Highest value of each signal per trajectory and whether it fired."""
    value = {s: F.col({"closure_gap": "closure_ratio", "orphaned_priv": "orphaned_privilege"}.get(s, s))
             for s in C.SIGNALS}
    value["closure_gap"] = 1.0 - F.col("closure_ratio")
    out = scores.groupBy(*keys).agg(
        *[F.max(v).cast("double").alias(f"{s}_max") for s, v in value.items()],
        F.max("residual_risk").alias("residual_risk_max"))
    return out.select("*", *[(F.col(f"{s}_max") > 0).alias(f"{s}_fired") for s in value])


def prediction_divergence(results: DataFrame) -> DataFrame:
    """Expected against fired, per signal; needs ``expected_signals`` and the fired flags."""
    cells = F.array(*[F.struct(F.lit(s).alias("signal"),
                               F.array_contains("expected_signals", s).alias("expected"),
                               F.col(f"{s}_fired").alias("fired")) for s in C.SIGNALS])
    n = lambda e, f: F.sum(((F.col("expected") == e) & (F.col("fired") == f)).cast("long"))
    return (results.select(F.explode(cells).alias("c")).select("c.*").groupBy("signal").agg(
        n(True, True).alias("expected_fired"), n(True, False).alias("expected_silent"),
        n(False, True).alias("unexpected_fired"), n(False, False).alias("unexpected_silent")))


def blind_spots(results: DataFrame, detected: Column, order: list, limit: int = 30) -> DataFrame:
    """The report lists the first undetected trajectories."""
    return results.where(~detected).orderBy(*order).limit(limit)


def residual_percentiles(scores: DataFrame, keys: list[str], value: str,
                         probs: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles; half ranks go to the even rank."""
    return values_at_ranks(scores, keys, value, {n: X.half_even_rank(F.col("n"), p) for n, p in probs.items()})


def recalibrate(attack: DataFrame, benign: DataFrame, value: str) -> DataFrame:
    """Thresholds from observed residuals: WATCH never under the benign noise floor."""
    a = residual_percentiles(attack, [], value, {"p75": 0.75, "p90": 0.90, "p95": 0.95})
    b = residual_percentiles(benign, [], value, {"benign_p95": 0.95}).drop("n")
    return (a.join(F.broadcast(b), F.lit(True))
            .select(F.greatest("p75", "benign_p95").alias("watch"), F.col("p90").alias("medium"),
                    F.col("p95").alias("high"), "benign_p95"))


def with_recalibrated_tier(rows: DataFrame, thresholds: DataFrame, value: str) -> DataFrame:
    """Tier under the one-row ``thresholds`` table."""
    tiers = X.tier(F.col(value), [("HIGH", F.col("high")), ("MEDIUM", F.col("medium")), ("WATCH", F.col("watch"))])
    return (rows.join(F.broadcast(thresholds), F.lit(True))
            .withColumn("recal_tier", tiers).withColumn("recal_detected", F.col(value) >= F.col("watch")))


def embed_in_baseline(benign: DataFrame, attack: DataFrame, prefix: str = "attack-") -> DataFrame:
    """Attack events under renamed actors, scored together with benign events."""
    renamed = attack.withColumn("actor_id", F.concat(F.lit(prefix), "actor_id"))
    return benign.unionByName(renamed)


def separation_stats(scores: DataFrame, category: str, value: str) -> DataFrame:
    """Distribution of a score per category."""
    probs = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
    flat = scores.groupBy(category).agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return null_safe_join(flat, linear_percentiles(scores, [category], value, probs).drop("n"), [category])


def effect_size(scores: DataFrame, is_attack: Column, value: str) -> DataFrame:
    """Cohen's d and ratio of means of attack against benign scores."""
    a, b = F.when(is_attack, F.col(value)), F.when(~is_attack, F.col(value))
    m = scores.agg(F.avg(a).alias("attack_mean"), F.avg(b).alias("benign_mean"),
                   F.stddev_pop(a).alias("_sa"), F.stddev_pop(b).alias("_sb"))
    pooled = F.sqrt((F.pow("_sa", F.lit(2)) + F.pow("_sb", F.lit(2))) / 2)
    diff = F.col("attack_mean") - F.col("benign_mean")
    return m.select(
        "attack_mean", "benign_mean", F.when(pooled > 0, diff / pooled).otherwise(0.0).alias("cohens_d"),
        F.when(F.col("benign_mean") > 0, F.col("attack_mean") / F.col("benign_mean"))
        .when(F.col("attack_mean") > 0, F.lit(float("inf"))).otherwise(1.0).alias("separation_ratio"))


def against_benign(stats: DataFrame, category: str, benign: str = "benign") -> DataFrame:
    """Add Cohen's d and the ratio of means of each category of :func:`separation_stats` against the benign one."""
    base = stats.where(F.col(category) == benign).select(F.col("mean").alias("_m"), F.col("std").alias("_s"))  # one row
    pooled = F.sqrt((F.pow("std", F.lit(2)) + F.pow("_s", F.lit(2))) / 2)
    other = F.coalesce(F.col(category) != benign, F.lit(True))
    return (stats.join(F.broadcast(base), F.lit(True), "left")
            .withColumn("cohens_d", F.when(other, F.when(pooled > 0, (F.col("mean") - F.col("_m")) / pooled).otherwise(0.0)))
            .withColumn("separation_ratio", F.when(other & (F.col("_m") > 0), F.col("mean") / F.col("_m")))
            .drop("_m", "_s"))


# --- alert budget -----------------------------------------------------------------

def alert_budget(alerts: DataFrame, per_day: int, day_seconds: float = 86400.0) -> DataFrame:
    """The ``per_day`` highest-scored alerts of each day.

    Spark keeps only the first ``per_day`` rows of each task before the
    shuffle, so a day with very many alerts is cheap.
    """
    best = alerts.groupBy("actor", "window_time").agg(F.max("score").alias("score"))
    day = F.floor(F.col("window_time") / F.lit(day_seconds)).cast("long")
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.col("score").desc(), "actor", "window_time"))
    return best.withColumn("day", day).withColumn("rank", rank).where(F.col("rank") <= per_day)


def campaign_detection(campaigns: DataFrame, budgeted: DataFrame) -> DataFrame:
    """For each campaign the best budgeted alert of its actor inside its interval, if any."""
    hits = (campaigns.select("actor", "t_start", "t_end").distinct().join(budgeted, "actor")
            .where((F.col("window_time") >= F.col("t_start")) & (F.col("window_time") <= F.col("t_end")))
            .groupBy("actor", "t_start", "t_end")
            .agg(F.min(F.struct((-F.col("score")).alias("s"), "window_time", "day")).alias("a")))
    return (campaigns.join(hits, ["actor", "t_start", "t_end"], "left")
            .select(*campaigns.columns, F.col("a").isNotNull().alias("detected"),
                    F.col("a.window_time").alias("alert_time"), (-F.col("a.s")).alias("alert_score"),
                    F.col("a.day").alias("budget_day")))


def budget_eval(detections: DataFrame) -> DataFrame:
    """Detected, missed and rate per flavor, and overall."""
    return (detections.rollup("flavor").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("detected").cast("long")).alias("tp"),
        F.grouping("flavor").alias("_all"))
        .select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("flavor")).alias("flavor"), "total", "tp",
                (F.col("total") - F.col("tp")).alias("fn"), (F.col("tp") / F.col("total")).alias("detection_rate")))


def campaigns_per_flavor(campaigns: DataFrame) -> DataFrame:
    return campaigns.groupBy("flavor").agg(F.count(F.lit(1)).alias("n_campaigns"))


def middle_windows(positioned: DataFrame, marked: DataFrame, width: int = 80, least: int = 160) -> DataFrame:
    """The benign counterpart of labelled intervals: the ``width`` transitions up to the middle of each long trajectory.

    Actors in ``marked`` are left out, as are those with fewer than ``least`` transitions.
    """
    size = positioned.groupBy("actor").agg(F.max("position").alias("_n")).where(F.col("_n") >= least)
    middle = F.floor(F.col("_n") / 2)
    inside = (F.col("position") > middle - width) & (F.col("position") <= middle)
    return (positioned.join(size.join(marked.select("actor").distinct(), "actor", "left_anti"), "actor").where(inside)
            .groupBy("actor").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
            .select("actor", F.lit("benign|").alias("window_id"), F.lit("benign").alias("flavor"), "t_start", "t_end"))


def instance_windows(positioned: DataFrame, campaigns: DataFrame, least: int = 5,
                     fallback: int = 80) -> DataFrame:
    """Time range to score for each labelled interval.

    An interval with fewer than ``least`` transitions falls back to the actor's
    last ``fallback`` transitions up to its end. ``positioned`` carries
    ``position``.
    """
    day = lambda t: F.floor(t / F.lit(86400.0)).cast("long")
    place = positioned.select("actor", "t", "position")
    # Counts come from positions at both ends, not from pairs of intervals and transitions.
    ends = materialize(asof_lookup(campaigns, place, ["actor"], "t_end", "t", ["position"], "_e", day,
                                   tie_order=["position"]), "ends")
    both = asof_lookup(ends, place, ["actor"], "t_start", "t", ["position"], "_s", day, strict=True,
                       tie_order=["position"])
    upto = both.where(F.col("_e").isNotNull()).select(
        *campaigns.columns, F.col("_e.position").alias("_last"),
        (F.col("_e.position") - F.coalesce("_s.position", F.lit(0))).alias("_in"))
    back = positioned.select("actor", F.col("position").alias("_first"), F.col("t").alias("_back"))
    return (upto.withColumn("_first", F.greatest(F.lit(1).cast("long"), F.col("_last") - fallback + 1))
            .join(back, ["actor", "_first"])
            .select("actor", F.concat_ws("|", "flavor", F.col("t_start").cast("string")).alias("window_id"), "flavor",
                    F.when(F.col("_in") < least, F.col("_back")).otherwise(F.col("t_start")).alias("t_start"), "t_end"))
