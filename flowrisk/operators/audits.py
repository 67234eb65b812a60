"""Audits of labelled evaluation data: leakage, structural equality, vocabulary."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.operators.ordered import linear_percentiles, null_safe_join, running_totals, with_quantile_slice
from flowrisk.operators.trajectory import EDGE
from flowrisk.session import cut_lineage, materialize

FEATURES = ["n_events", "n_resources", "n_edges", "n_actions", "edge_diversity", "max_degree", "mean_degree"]


def benign_spans(transitions: DataFrame, campaigns: DataFrame, width: float | None = None) -> DataFrame:
    """Consecutive spans of each actor that touch none of its labelled intervals.

    ``width`` defaults to the median interval length. Spans are numbered from
    the actor's first event, so an interval blocks a range of numbers and the
    overlap test becomes an equality on (actor, number).
    """
    lengths = campaigns.where(F.col("t_end") > F.col("t_start")).withColumn("_len", F.col("t_end") - F.col("t_start"))
    wide = (linear_percentiles(lengths, [], "_len", {"width": 0.5}).select("width") if width is None
            else lengths.sparkSession.range(1).select(F.lit(float(width)).alias("width")))
    lives = (transitions.groupBy("actor").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
             .join(F.broadcast(wide), F.lit(True)))
    count = F.floor((F.col("hi") - F.col("lo")) / F.col("width")).cast("long")
    spans = lives.where(count >= 1).withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    at = lambda c: (F.col(c) - F.col("lo")) / F.col("width")
    first = F.greatest(F.lit(0), F.floor(at("t_start"))).cast("long")
    last = (F.ceil(at("t_end")) - 1).cast("long")
    blocked = (campaigns.select("actor", "t_start", "t_end").join(lives, "actor").where(first <= last)
               .select("actor", F.explode(F.sequence(first, F.least(last, count))).alias("span")).distinct())
    return (spans.join(blocked, ["actor", "span"], "left_anti")
            .select("actor", "span", (F.col("lo") + F.col("span") * F.col("width")).alias("t_start"),
                    (F.col("lo") + (F.col("span") + 1) * F.col("width")).alias("t_end")))


def span_features(transitions: DataFrame, spans: DataFrame, key: str, bucket_seconds: float = 86400.0) -> DataFrame:
    """Shallow features of one actor's transitions in [t_start, t_end), one row per span ``key``.

    Spans and transitions meet only in the time buckets they share. Distinct
    counts come from grouping by what is counted first, so no set is held for a
    whole span.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(bucket_seconds)).cast("long")
    covered = spans.select(key, "actor", "t_start", "t_end",
                           F.explode(F.sequence(bucket("t_start"), bucket("t_end"))).alias("_b"))
    rows = (transitions.withColumn("_b", bucket("t")).join(covered, ["actor", "_b"])
            .where((F.col("t") >= F.col("t_start")) & (F.col("t") < F.col("t_end"))))
    by_edge = materialize(rows.groupBy(key, *EDGE).agg(F.count(F.lit(1)).alias("c")), "span_edges")
    edges = by_edge.groupBy(key).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("e"))
    actions = by_edge.select(key, "action").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    degrees = (by_edge.select(key, "c", F.explode(F.array("src", "dst")).alias("node"))
               .groupBy(key, "node").agg(F.sum("c").alias("deg"))
               .groupBy(key).agg(F.count(F.lit(1)).alias("r"), F.max("deg").alias("dmax"), F.avg("deg").alias("davg")))
    zero = F.lit(0.0)
    full = spans.select(key).join(edges, key, "left").join(actions, key, "left").join(degrees, key, "left")
    return full.select(
        key, *[F.coalesce(F.col(c).cast("double"), zero).alias(name) for c, name in
               (("n", "n_events"), ("r", "n_resources"), ("e", "n_edges"), ("a", "n_actions"))],
        F.coalesce(F.col("e") / F.col("n"), zero).alias("edge_diversity"),
        F.coalesce(F.col("dmax").cast("double"), zero).alias("max_degree"),
        F.coalesce("davg", zero).alias("mean_degree"))


def average_precision(scored: DataFrame, keys: list[str], score: str, label: str,
                      weight: Column | None = None, slices: int = 256) -> DataFrame:
    """Average precision and prevalence per key; equal scores form one threshold.

    The distinct scores are cut into slices of equal size, so the running counts
    of a large group do not sit in one task.
    """
    w = F.lit(1.0) if weight is None else weight
    steps = (scored.groupBy(*keys, (-F.col(score)).alias("_s"))
             .agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("p"))
             .where(F.col("n") > 0))
    steps = with_quantile_slice(steps, keys, "_s", "_cut", slices)
    run = running_totals(steps, keys, ["_s"], {"_n": F.col("n"), "_p": F.col("p")}, F.col("_cut"))
    precision = (F.col("_p") + F.col("p")) / (F.col("_n") + F.col("n"))
    return run.groupBy(*keys).agg(
        F.try_divide(F.sum(precision * F.col("p")), F.sum("p")).alias("average_precision"),
        (F.sum("p") / F.sum("n")).alias("prevalence"))


PRIME = (1 << 31) - 1
EQUAL_ROWS = 64       # equal rows that draw together
PART_ROWS = 4_096     # distinct scores of a task
DRAW_ROWS = 256       # rows whose draws are held together


def poisson_steps(rows: int) -> list[float]:
    """Cumulative probabilities of Poisson(rows), until they add nothing."""
    p = total = math.exp(-rows)
    steps = [total]
    while total + (p := p * rows / len(steps)) > total or len(steps) < rows:
        total += p
        steps.append(total)
    return steps


def bootstrap_intervals(scored: DataFrame, keys: list[str], score: str, label: str, replicates: int = 1000,
                        bounds: tuple[float, float] = (0.025, 0.975), seed: int = 42) -> DataFrame:
    """Bootstrap interval of the average precision per key: (keys..., ci_lower, ci_upper).

    Poisson counts stand in for resampling: n equal rows (key, score to nine decimals, label) are drawn Poisson(n) times in a replicate, EQUAL_ROWS
    of them at a time, by inversion of one uniform number. That number is a quadratic polynomial of the replicate modulo a prime, whose three
    coefficients are digits of an MD5 of the rows' values, so any engine draws the same. A replicate without a positive row has no average precision.

    Rows are never multiplied by replicates: distinct scores are sorted over the cluster, a task holds some PART_ROWS of them, and the draws of
    all replicates are vectors. A first pass sums them per task, a second one adds the sums of the tasks before.
    """
    rows = scored.select(*keys, F.round(score, 9).alias("_s"), F.col(label).cast("long").alias("_y"))
    equal = rows.groupBy(*keys, "_s", "_y").agg(F.count(F.lit(1)).alias("_n"))
    # Blocks of equal rows, numbered without a long array in a row.
    chunks = F.ceil(F.col("_n") / EQUAL_ROWS) - 1
    high = equal.withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(chunks / 4096))))
    each = high.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(4095).cast("long"), chunks - F.col("_hi") * 4096))))
    number = F.col("_hi") * 4096 + F.col("_lo")
    name = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.round(F.col("_s") * 1e9).cast("long").cast("string"),
                             F.col("_y").cast("string"), number.cast("string")).cast("binary"))
    digits = [F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("long") % PRIME for i in range(3)]
    drawn = each.select(*keys, "_s", "_y", F.least(F.lit(EQUAL_ROWS).cast("long"), F.col("_n") - number * EQUAL_ROWS).alias("_m"),
                        *[d.alias(f"_d{i}") for i, d in enumerate(digits)])
    drawn = materialize(drawn, "bootstrap-rows")
    parts = -(-max(1, drawn.count()) // PART_ROWS)
    # Equal scores of a key stay in one part; no numeric key column is needed, only an order.
    placed = drawn.repartitionByRange(parts, *keys, F.col("_s").desc()).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "bootstrap-parts")
    steps = [poisson_steps(m) for m in range(1, EQUAL_ROWS + 1)]
    kinds = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys)

    def draws(part: pd.DataFrame) -> np.ndarray:
        """How often each row comes in each replicate."""
        r = np.arange(1, replicates + 1, dtype="int64")
        a, b, c = (part[f"_d{i}"].to_numpy()[:, None] for i in range(3))
        u = ((a * (r * r) % PRIME + b * r + c) % PRIME) / PRIME
        out = np.empty(u.shape, "int64")
        m = part["_m"].to_numpy()
        for size in np.unique(m):
            out[m == size] = np.searchsorted(steps[size - 1], u[m == size], side="right")
        return out

    def blocks(part: pd.DataFrame):
        """(weights, weights of positive rows) summed per score, best score first, some scores at a time."""
        part = part.sort_values("_s", ascending=False, kind="stable")
        score = part["_s"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        at = 0
        while at < len(starts):
            to = at + 1
            while to < len(starts) and (starts[to + 1] if to + 1 < len(starts) else len(part)) - starts[at] <= DRAW_ROWS:
                to += 1
            stop = starts[to] if to < len(starts) else len(part)
            n = np.zeros((to - at, replicates), "int64")
            p = np.zeros_like(n)
            # One score may have many rows.
            for lo in range(starts[at], stop, DRAW_ROWS):
                some = part.iloc[lo:min(stop, lo + DRAW_ROWS)]
                k, place = draws(some), np.searchsorted(starts[at:to], np.arange(lo, min(stop, lo + DRAW_ROWS)), "right") - 1
                np.add.at(n, place, k)
                np.add.at(p, place, k * some["_y"].to_numpy()[:, None])
            yield n, p
            at = to

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in part.groupby(keys, dropna=False, sort=False):
            n, p = (sum(x) for x in zip(*((n.sum(axis=0), p.sum(axis=0)) for n, p in blocks(own))))
            frame = pd.DataFrame({"replicate": np.arange(replicates), "n": n, "p": p, "_part": own["_part"].iloc[0]})
            out.append(frame.assign(**{k: [own[k].iloc[0]] * replicates for k in keys}))
        return pd.concat(out)

    def precisions(key, part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in part.groupby(keys, dropna=False, sort=False):
            first = before
            for k in keys:
                v = own[k].iloc[0]
                first = first[first[k].isna() if pd.isna(v) else first[k] == v]
            first = first.sort_values("replicate")
            n0, p0, total = first["n"].to_numpy(), first["p"].to_numpy(), np.zeros(replicates)
            for n, p in blocks(own):
                upto_n, upto_p = n0 + n.cumsum(axis=0), p0 + p.cumsum(axis=0)
                total += np.where(p > 0, upto_p / np.maximum(upto_n, 1) * p, 0.0).sum(axis=0)
                n0, p0 = upto_n[-1], upto_p[-1]
            frame = pd.DataFrame({"replicate": np.arange(replicates), "s": total})
            out.append(frame.assign(**{k: [own[k].iloc[0]] * replicates for k in keys}))
        return pd.concat(out)

    totals = materialize(placed.groupBy("_part").applyInPandas(sums, f"{kinds}, _part int, replicate long, n long, p long"), "bootstrap-sums")
    ahead = Window.partitionBy(*keys, "replicate").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", "replicate", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("n", "p")])
    found = placed.groupBy("_part").cogroup(before.groupBy("_part")).applyInPandas(precisions, f"{kinds}, replicate long, s double")
    positives = totals.groupBy(*keys, "replicate").agg(F.sum("p").alias("p"))
    each = null_safe_join(found.groupBy(*keys, "replicate").agg(F.sum("s").alias("s")), positives, [*keys, "replicate"])
    values = materialize(each.where("p > 0").select(*keys, (F.col("s") / F.col("p")).alias("average_precision")), "replicates")
    return linear_percentiles(values, keys, "average_precision", {"ci_lower": bounds[0], "ci_upper": bounds[1]}).drop("n")


def leakage_audit(samples: DataFrame, train: Column, replicates: int = 1000, stratum_replicates: int = 500,
                  min_positives: int = 10, margin: float = 0.05, seed: int = 42) -> DataFrame:
    """Can a shallow classifier tell labelled spans from benign ones?

    ``samples`` has the span features, ``y`` and ``flavor`` (``benign`` for
    negatives), and ``train`` marks the training groups. A balanced logistic
    regression is fitted and its average precision on held-out rows gets a
    bootstrap interval, overall and per flavor. A stratum is at chance when the
    upper bound stays within ``margin`` of the prevalence.
    """
    samples = materialize(samples.withColumn("_train", train), "samples")
    fit, rest = samples.where("_train"), samples.where("NOT _train")
    share = fit.groupBy("y").agg((F.count(F.lit(1))).alias("_n"))
    total = fit.agg(F.count(F.lit(1)).alias("_all"))
    weights = share.join(F.broadcast(total), F.lit(True)).select("y", (F.col("_all") / (2 * F.col("_n"))).alias("_w"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    data = cut_lineage(vectors.transform(fit.join(F.broadcast(weights), "y"))
                       .select("features", F.col("y").cast("double").alias("label"), "_w"))
    n = data.count()
    model = LogisticRegression(maxIter=1000, regParam=1.0 / max(n, 1), standardization=False,
                               weightCol="_w").fit(data)
    scored = model.transform(vectors.transform(rest)).select(
        "y", "flavor", F.round(vector_to_array("probability")[1], 12).alias("score"))
    held = cut_lineage(scored)
    flavors = held.where("y = 1").groupBy("flavor").agg(F.count(F.lit(1)).alias("n_pos"))
    strata = materialize(held.where("y = 1").withColumn("stratum", F.explode(F.array(F.lit("ALL"), F.col("flavor"))))
              .unionByName(held.where("y = 0").withColumn("stratum", F.lit("ALL")))
              .unionByName(held.where("y = 0").join(F.broadcast(flavors.select(F.col("flavor").alias("stratum"))),
                                                    F.lit(True))), "strata")
    point = average_precision(strata, ["stratum"], "score", "y")
    bounds = bootstrap_intervals(strata.where("stratum = 'ALL'"), ["stratum"], "score", "y", replicates, seed=seed).unionByName(
        bootstrap_intervals(strata.where("stratum <> 'ALL'"), ["stratum"], "score", "y", stratum_replicates, seed=seed))
    n_pos = strata.groupBy("stratum").agg(F.sum("y").alias("n_pos"))
    chance = F.col("ci_upper") <= F.col("prevalence") + margin
    status = (F.when((F.col("stratum") != "ALL") & (F.col("n_pos") < min_positives), "INCONCLUSIVE")
              .when(chance, "at_chance").otherwise("EXCEEDS_NO_SKILL"))
    return (point.join(bounds, "stratum", "left").join(n_pos, "stratum")
            .select("stratum", "n_pos", "average_precision", "prevalence", "ci_lower", "ci_upper", status.alias("status")))


def ks_two_sample(values: DataFrame, value: str, in_first: Column, keys: list[str] | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic with the asymptotic p-value."""
    keys = keys or []
    counts = values.groupBy(*keys, F.col(value).alias("_v")).agg(
        F.sum(in_first.cast("long")).alias("a"), F.sum((~in_first).cast("long")).alias("b"))
    sizes = counts.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    counts = with_quantile_slice(counts, keys, "_v", "_cut")
    run = running_totals(counts, keys, ["_v"], {"_a": F.col("a"), "_b": F.col("b")}, F.col("_cut"))
    both = null_safe_join(run, sizes, keys) if keys else run.join(F.broadcast(sizes), F.lit(True))
    gap = F.abs((F.col("_a") + F.col("a")) / F.col("n1") - (F.col("_b") + F.col("b")) / F.col("n2"))
    out = both.groupBy(*keys, "n1", "n2").agg(F.max(gap).alias("statistic"))
    x2 = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")) * F.pow("statistic", F.lit(2))
    tail = sum(((-1.0) ** (k - 1) * 2 * F.exp(-2.0 * k * k * x2) for k in range(1, 60)), F.lit(0.0))
    return out.withColumn("p_value", F.when(F.col("statistic") == 0, 1.0)
                          .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))))


def degree_dist(transitions: DataFrame, keys: list[str]) -> DataFrame:
    """Number of transition ends at each node."""
    return (transitions.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
            .groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree")))


def iqr_check(benign: DataFrame, attack: DataFrame, value: str, slack: float = 1.0) -> DataFrame:
    """How many attack values lie outside the benign interquartile range, widened by ``slack``."""
    q = linear_percentiles(benign, [], value, {"q1": 0.25, "q3": 0.75}).drop("n")
    outside = (F.col(value) < F.col("q1") - slack) | (F.col(value) > F.col("q3") + slack)
    return (attack.join(F.broadcast(q), F.lit(True)).groupBy("q1", "q3")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(outside.cast("long")).alias("n_outside"))
            .withColumn("passed", F.col("n_outside") == 0))


def activity_check(per_actor: DataFrame, active_from: int = 50, required: int = 80) -> DataFrame:
    """Fewest, median and mean transitions of active actors against the required minimum."""
    active = per_actor.where(F.col("n_transitions") >= active_from)
    middle = linear_percentiles(active, [], "n_transitions", {"median": 0.5}).drop("n")
    return (active.agg(F.count(F.lit(1)).alias("n_actors"), F.min("n_transitions").alias("min"),
                       F.avg("n_transitions").alias("mean"))
            .join(F.broadcast(middle), F.lit(True))
            .select("n_actors", "min", F.floor("median").alias("median"), "mean",
                    (F.col("min") >= required).alias("passed")))


def leak_scan(rows: DataFrame, id_columns: list[str], vocabulary: list[str] | None = None) -> DataFrame:
    """Every (row, column, forbidden word) where the word occurs in the value, letter case aside."""
    words = sorted({w.lower() for w in (C.LEAK_VOCABULARY if vocabulary is None else vocabulary)})
    columns = [c for c in rows.columns if c not in id_columns]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lower(F.col(c).cast("string")).alias("value")) for c in columns])
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("value"), w))
    return (rows.select(*id_columns, F.explode(cells).alias("c")).select(*id_columns, "c.column", "c.value")
            .select(*id_columns, "column", F.explode(found).alias("word")))
