"""Eleven rules per (window, actor), evaluated for all keys in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.config import WorldConfig
from flowrisk.functions import expressions as X
from flowrisk.operators.world import WINDOW_KEY, mark_new


def _with_known(activity: DataFrame, known: DataFrame) -> DataFrame:
    return activity.join(known.select("actor_id").distinct().withColumn("_known", F.lit(True)),
                         "actor_id", "left")


def _simple() -> list:
    return [
        (F.col("n_policy_no_deploy") > 0).alias("INV_001"),
        (F.col("n_create_key") > 0).alias("INV_002"),
        ((F.col("n_create_key") > 0) & F.col("_known").isNull()).alias("INV_003"),
        (F.col("n_impersonate") > 0).alias("INV_004"),
        ((F.col("n_policy") > 0) & (F.col("n_secret") > 0)).alias("INV_007"),
        (F.col("n_metadata") > 0).alias("INV_009")]


def _past(cfg: WorldConfig):
    """Earlier windows of the actor inside the lookback."""
    return (Window.partitionBy("actor_id").orderBy(F.unix_seconds("window_start"))
            .rangeBetween(-cfg.lookback_seconds, -1))


def _spike(cfg: WorldConfig) -> list:
    n = F.col("n_impersonate")
    baseline = F.avg(F.when(n > 0, n)).over(_past(cfg))
    return [baseline.alias("impersonation_baseline"),
            ((n > 0) & (baseline.isNull() | (n > 2 * baseline))).alias("INV_005")]


def _bare(cfg: WorldConfig) -> list:
    chained, total = F.sum("n_chained").over(_past(cfg)), F.sum("event_count").over(_past(cfg))
    service = F.col("actor_id").contains(".iam.gserviceaccount.com")
    usual = F.coalesce((total >= 10) & (chained / total >= 0.8), F.lit(False))
    return [F.coalesce(chained, F.lit(0)).alias("past_chained"), F.coalesce(total, F.lit(0)).alias("past_events"),
            (service & (F.col("event_count") > F.col("n_chained")) & usual).alias("INV_011")]


def simple_rules(activity: DataFrame, known: DataFrame) -> DataFrame:
    """Rules that look at one window only. ``known`` lists known initiators (``actor_id``)."""
    return _with_known(activity, known).select(*WINDOW_KEY, *_simple())


def impersonation_spike(activity: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """More than twice the mean of earlier windows that had any impersonation."""
    return activity.select(*WINDOW_KEY, "n_impersonate", *_spike(cfg))


def missing_delegation(activity: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """A service account that usually acts through a delegation chain acts without one."""
    return activity.select(*WINDOW_KEY, *_bare(cfg))


def novel_access(targets: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """Secrets read and keys used that the actor has not touched in the lookback."""
    out = None
    for rule, count in (("INV_006", "n_secret"), ("INV_008", "n_decrypt")):
        new = mark_new(targets.where(F.col(count) > 0), ["actor_id", "target_id"],
                       cfg.lookback_seconds, "is_new")
        rows = new.where("is_new").select(*WINDOW_KEY, F.lit(rule).alias("rule"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(*WINDOW_KEY).agg(
        F.bool_or(F.col("rule") == "INV_006").alias("INV_006"),
        F.bool_or(F.col("rule") == "INV_008").alias("INV_008"))


def new_sensitive_edge(edges: DataFrame) -> DataFrame:
    """A new transition into SECRET or EXFIL_RISK; ``edges`` carries ``is_new``."""
    return (edges.where(F.col("is_new") & F.col("target_zone").isin("SECRET", "EXFIL_RISK"))
            .select(*WINDOW_KEY).distinct().withColumn("INV_010", F.lit(True)))


def check_invariants(activity: DataFrame, targets: DataFrame, edges: DataFrame, known: DataFrame,
                     cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """All rules, with score (highest severity), count and sorted ids of fired rules."""
    rules = sorted(C.INVARIANT_SEVERITY)
    # One shuffle by actor serves the lookup and both history rules.
    joined = (_with_known(activity, known).select(*WINDOW_KEY, *_simple(), *_spike(cfg), *_bare(cfg))
              .join(novel_access(targets, cfg), WINDOW_KEY, "left")
              .join(new_sensitive_edge(edges), WINDOW_KEY, "left"))
    return roll_up(joined.select(*WINDOW_KEY, *[F.coalesce(r, F.lit(False)).alias(r) for r in rules]))


def roll_up(flags: DataFrame) -> DataFrame:
    """Score, count and ids from one boolean column per rule."""
    rules = sorted(C.INVARIANT_SEVERITY)
    fired = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in rules]))
    worst = F.greatest(*[F.when(F.col(r), float(C.INVARIANT_SEVERITY[r])).otherwise(0.0) for r in rules])
    return flags.select(*WINDOW_KEY, *rules, worst.alias("inv_score"),
                        F.size(fired).alias("inv_count"), F.array_sort(fired).alias("fired_invariants"))


def explain(events: DataFrame, flags: DataFrame, activity: DataFrame, edges: DataFrame,
            targets: DataFrame, cfg: WorldConfig = WorldConfig()) -> DataFrame:
    """One sentence per fired rule, joined in rule order; built only for fired rules.

    Where a rule names a resource it is the one used first in the window, by time and then by name.
    """
    first = lambda action: F.min(F.when(F.col("action_type") == action, F.struct(
        "ts", "event_id", "target_id")))["target_id"]
    named = (events.where(F.col("action_type").isin("IAM_CREATE_KEY", "IAM_IMPERSONATE",
                                                    "COMPUTE_METADATA_CHANGE"))
             .groupBy(*WINDOW_KEY).agg(first("IAM_CREATE_KEY").alias("_key"),
                                       first("IAM_IMPERSONATE").alias("_imp"),
                                       first("COMPUTE_METADATA_CHANGE").alias("_meta")))
    new = lambda count, name: (mark_new(targets.where(F.col(count) > 0), ["actor_id", "target_id"],
                                        cfg.lookback_seconds, "is_new").where("is_new")
                               .join(targets.select(*WINDOW_KEY, "target_id", "first_ts"), [*WINDOW_KEY, "target_id"])
                               .groupBy(*WINDOW_KEY).agg(F.min(F.struct("first_ts", "target_id"))["target_id"].alias(name)))
    edge = (edges.where(F.col("is_new") & F.col("target_zone").isin("SECRET", "EXFIL_RISK"))
            .groupBy(*WINDOW_KEY).agg(F.min(F.struct("source_zone", "target_zone")).alias("_edge")))
    spike = impersonation_spike(activity, cfg).select(*WINDOW_KEY, "n_impersonate", "impersonation_baseline")
    bare = missing_delegation(activity, cfg).select(*WINDOW_KEY, "past_chained", "past_events")
    full = flags.join(activity.select(*WINDOW_KEY, "event_count", "n_chained"), WINDOW_KEY)
    for part in (named, new("n_secret", "_secret"), new("n_decrypt", "_crypt"), edge, spike, bare):
        full = full.join(part, WINDOW_KEY, "left")
    actor = F.col("actor_id")
    text = {
        "INV_001": F.format_string("%s changed an access policy and no deployment was under way", actor),
        "INV_002": F.format_string("a service-account key was issued for %s", "_key"),
        "INV_003": F.format_string("%s, not seen before, issued a service-account key", actor),
        "INV_004": F.format_string("%s acted as %s", actor, "_imp"),
        "INV_005": F.format_string("%d impersonations where %s are usual", "n_impersonate",
                                   X.fixed(F.coalesce("impersonation_baseline", F.lit(0.0)), 1)),
        "INV_006": F.format_string("%s read secret %s for the first time", actor, "_secret"),
        "INV_007": F.lit("a secret was read and an access policy changed in one window"),
        "INV_008": F.format_string("%s decrypted with %s for the first time", actor, "_crypt"),
        "INV_009": F.format_string("instance metadata of %s was changed", "_meta"),
        "INV_010": F.format_string("%s went from %s to %s for the first time", actor, F.col("_edge.source_zone"),
                                   F.col("_edge.target_zone")),
        "INV_011": F.format_string(
            "%s acted %d times without delegation, which it had %d times in %d before (%s%%)", actor,
            F.col("event_count") - F.col("n_chained"), "past_chained", "past_events",
            X.fixed(100 * F.col("past_chained") / F.nullif("past_events", F.lit(0)), 0)),
    }
    said = F.concat_ws("; ", *[F.when(F.col(r), text[r]) for r in sorted(text)])
    return full.select(*WINDOW_KEY, F.when(said == "", "no rule fired").otherwise(said)
                       .alias("explanation"))
