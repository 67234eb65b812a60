"""Actor trajectories: transitions, irreversibility and departure from own history.

A transition is a row (actor, t, src, dst, action) with a unique tie-breaker
column ``seq``; ``t`` is in seconds.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.functions import expressions as X
from flowrisk.operators.ordered import null_safe_join, running_totals, slice_crowded, with_position, with_previous
from flowrisk.session import materialize

ORDER = ["t", "seq"]
EDGE = ["src", "dst", "action"]
DAY_SECONDS = 86400


def day_slice(seconds: int = DAY_SECONDS) -> Column:
    return F.floor(F.col("t") / F.lit(float(seconds))).cast("long")


def from_state_visits(visits: DataFrame, slice_seconds: int = DAY_SECONDS) -> DataFrame:
    """Transitions between consecutive states of an actor: (actor, t, seq, state, action) in.

    The action and time are those of the arrival.
    """
    moved = slice_crowded(visits, ["actor"], day_slice(slice_seconds),
                          lambda rows, piece: with_previous(rows, ["actor"], ORDER, {"src": "state"}, piece))
    return moved.where(F.col("src").isNotNull()).select(
        "actor", "t", "seq", "src", F.col("state").alias("dst"), "action")


def positions(transitions: DataFrame, slice_seconds: int = DAY_SECONDS) -> DataFrame:
    """Number the transitions of each actor from 1 in time order."""
    return slice_crowded(transitions, ["actor"], day_slice(slice_seconds),
                         lambda rows, piece: with_position(rows, ["actor"], ORDER, "position", piece))


def between(transitions: DataFrame, t_from, t_to) -> DataFrame:
    """Transitions with t in [t_from, t_to)."""
    return transitions.where((F.col("t") >= t_from) & (F.col("t") < t_to))


def truncate(transitions: DataFrame, n: int) -> DataFrame:
    """The first ``n`` transitions of each actor."""
    return positions(transitions).where(F.col("position") <= n).drop("position")


def state_space(transitions: DataFrame) -> DataFrame:
    """Distinct states of each actor, one row each."""
    return (transitions.select("actor", F.explode(F.array("src", "dst")).alias("state")).distinct())


def reverse(transitions: DataFrame) -> DataFrame:
    """Time-reversed trajectories: source and destination swapped, times mirrored."""
    last = transitions.groupBy("actor").agg(F.max("t").alias("_last"))
    return (transitions.join(last, "actor")
            .select("actor", (F.col("_last") - F.col("t")).alias("t"), "seq",
                    F.col("dst").alias("src"), F.col("src").alias("dst"), "action"))


def edge_balance(transitions: DataFrame) -> DataFrame:
    """Forward and reverse count of every edge in the union support, per actor."""
    ahead = transitions.select("actor", *EDGE, F.lit(1).alias("f"), F.lit(0).alias("b"))
    back = transitions.select("actor", F.col("dst").alias("src"), F.col("src").alias("dst"), "action",
                              F.lit(0).alias("f"), F.lit(1).alias("b"))
    return (ahead.unionByName(back).groupBy("actor", *EDGE)
            .agg(F.sum("f").alias("forward"), F.sum("b").alias("backward")))


def kl_irreversibility(transitions: DataFrame, alpha: float = 1.0) -> DataFrame:
    """KL divergence of the trajectory from its reverse, with additive smoothing.

    Forward and reverse totals are equal, so one pass over edge counts is enough.
    """
    f, b = F.col("forward") + alpha, F.col("backward") + alpha
    return (edge_balance(transitions).groupBy("actor")
            .agg((F.sum(f * F.log(f / b)) / F.sum(f)).alias("kl"))
            .withColumn("kl", F.greatest(F.lit(0.0), "kl")))


def flux_divergence(transitions: DataFrame) -> DataFrame:
    """L1 and largest difference of edge shares forward and reversed; needs two transitions."""
    gap = F.abs(F.col("forward") - F.col("backward"))
    return (edge_balance(transitions).groupBy("actor")
            .agg(F.sum("forward").alias("n_transitions"), F.sum(gap).alias("_l1"), F.max(gap).alias("_max"))
            .where(F.col("n_transitions") >= 2)
            .select("actor", "n_transitions", (F.col("_l1") / F.col("n_transitions")).alias("flux_l1"),
                    (F.col("_max") / F.col("n_transitions")).alias("flux_max")))


def node_divergence(transitions: DataFrame) -> DataFrame:
    """Outflow minus inflow of each node, as a share of the actor's transitions."""
    ends = transitions.select("actor", F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("s")),
        F.struct(F.col("dst").alias("node"), F.lit(-1).alias("s")))).alias("e"))
    size = transitions.groupBy("actor").agg(F.count(F.lit(1)).alias("_n"))
    return (ends.groupBy("actor", F.col("e.node").alias("node")).agg(F.sum("e.s").alias("_net"))
            .join(size, "actor").select("actor", "node", (F.col("_net") / F.col("_n")).alias("divergence")))


def _smoothed_kl(edges: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """KL(window || baseline) per key from edge counts ``w`` and ``b``; 0 without a baseline."""
    w, b = F.col("w") + alpha, F.col("b") + alpha
    got = edges.groupBy(*keys).agg(F.sum("w").alias("n_window"), F.sum("b").alias("n_baseline"),
                                   F.count(F.lit(1)).alias("_e"), F.sum(w * F.log(w / b)).alias("_s"))
    tw = F.col("n_window") + alpha * F.col("_e")
    tb = F.col("n_baseline") + alpha * F.col("_e")
    score = F.when(F.col("n_baseline") == 0, 0.0) \
        .otherwise(F.greatest(F.lit(0.0), F.col("_s") / tw + F.log(tb / tw)))
    return got.where(F.col("n_window") > 0).select(*keys, "n_window", "n_baseline", score.alias("excess"))


def excess_kl(transitions: DataFrame, windows: DataFrame, alpha: float = 1.0) -> DataFrame:
    """How far each window of an actor departs from the rest of its history.

    ``windows`` has (actor, window_id, t_start, t_end), both ends included, and
    few windows per actor. The baseline is what came before the end of the
    window, less everything inside its time range.
    """
    both = transitions.join(windows, "actor").where(F.col("t") <= F.col("t_end"))
    inside = (F.col("t") >= F.col("t_start")).cast("long")
    edges = (both.groupBy("actor", "window_id", *EDGE)
             .agg(F.sum(inside).alias("w"), F.sum(1 - inside).alias("b")))
    return _smoothed_kl(edges, ["actor", "window_id"], alpha)


def last_windows(transitions: DataFrame, n: int) -> DataFrame:
    """Time range of the last ``n`` transitions of each actor that has more."""
    p = positions(transitions)
    size = p.groupBy("actor").agg(F.max("position").alias("_n"))
    return (p.join(size, "actor").where((F.col("position") > F.col("_n") - n) & (F.col("_n") > n))
            .groupBy("actor").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
            .withColumn("window_id", F.lit(0)))


class _Sliding:
    """Edge sums of a moving window: sizes in it (w) and before it (b), updated as one row enters or leaves."""

    def __init__(self, alpha: float):
        self.alpha, self.edges = alpha, {}
        self.shared, self.ww, self.wb, self.shared_log = 0, 0.0, 0.0, 0.0

    def _add(self, w: int, b: int, sign: int) -> None:
        a = self.alpha
        log_b = math.log(b + a)
        self.ww += sign * (w + a) * math.log(w + a)
        self.wb += sign * (w + a) * log_b
        if b:
            self.shared += sign
            self.shared_log += sign * log_b

    def enter(self, edge: tuple, count: int) -> None:
        w, b = self.edges.get(edge, (0, count - 1))
        if w:
            self._add(w, b, -1)
        self.edges[edge] = (w + 1, b)
        self._add(w + 1, b, 1)

    def leave(self, edge: tuple) -> None:
        w, b = self.edges[edge]
        self._add(w, b, -1)
        if w == 1:
            del self.edges[edge]
        else:
            self.edges[edge] = (w - 1, b + 1)
            self._add(w - 1, b + 1, 1)

    def score(self, n: int, base: int, seen: int, log_seen: float) -> float:
        """Excess of the window over the ``base`` earlier rows with ``seen`` edges, whose ln(1 + count / alpha) sum is log_seen."""
        if not base:
            return 0.0
        a = self.alpha
        support = len(self.edges) + seen - self.shared
        tw, tb = n + a * support, base + a * support
        rest = seen - self.shared
        rest_log = log_seen + seen * math.log(a) - self.shared_log
        return max(0.0, (self.ww - self.wb + a * (rest * math.log(a) - rest_log)) / tw + math.log(tb / tw))


def rolling_excess(transitions: DataFrame, window_size: int = 80, alpha: float = 1.0, stride: int = 1,
                   slice_seconds: int = DAY_SECONDS, chunk: int = 4096) -> DataFrame:
    """Excess of every ``window_size`` transitions over all earlier ones of the actor.

    One row per window end; windows end at positions window_size,
    window_size + stride, ... No window rescans its history. The sum over
    baseline edges that the window lacks comes from a running sum of
    ln(count + alpha) over seen edges, and the baseline count of a window edge
    is its running count at its first use in the window. An actor's rows are
    cut into chunks of ``chunk`` positions, each with the window_size - 1 rows
    before it, and one pass over a chunk moves the window along.
    """
    p = materialize(positions(transitions, slice_seconds), "positions")
    c = materialize(with_position(p, ["actor", *EDGE], ORDER, "_c", day_slice(slice_seconds)), "counted")
    step = F.log((F.col("_c") + alpha) / (F.col("_c") - 1 + alpha))
    h = running_totals(c, ["actor"], ORDER, {
        "_log_seen": step, "_seen": (F.col("_c") == 1).cast("long")}, day_slice(slice_seconds))
    of = lambda at: F.floor((at - 1) / F.lit(chunk)).cast("long")
    rows = h.withColumn("_chunk", F.explode(F.sequence(of(F.col("position")), of(F.col("position") + window_size - 1))))
    kind = transitions.schema["actor"].dataType.simpleString()

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("position")
        at, count, seen, log_seen, t = (part.column(x).to_pylist() for x in ("position", "_c", "_seen", "_log_seen", "t"))
        edges = list(zip(*(part.column(x).to_pylist() for x in EDGE)))
        first_own = part.column("_chunk")[0].as_py() * chunk + 1
        window, ends, times, scores = _Sliding(alpha), [], [], []
        for i, edge in enumerate(edges):
            window.enter(edge, count[i])
            start = i - window_size + 1
            if start > 0:
                window.leave(edges[start - 1])
            if start >= 0 and at[i] >= first_own and (at[i] - window_size) % stride == 0:
                ends.append(at[i])
                times.append(t[i])
                scores.append(window.score(window_size, at[start] - 1, seen[start], log_seen[start]))
        actor = part.column("actor").take(pa.array([0] * len(ends), pa.int64()))
        return pa.table({"actor": actor, "end_position": pa.array(ends, pa.int64()), "window_time": pa.array(times, pa.float64()),
                         "score": pa.array(scores, pa.float64())})

    wanted = rows.select("actor", "_chunk", "position", F.col("t").cast("double").alias("t"), *EDGE, "_c", "_seen", "_log_seen")
    return wanted.groupBy("actor", "_chunk").applyInArrow(run, f"actor {kind}, end_position long, window_time double, score double")


def entropy_rate(transitions: DataFrame, window_size: int = 50) -> DataFrame:
    """Change of destination entropy between the first two windows, in nats per transition."""
    p = positions(transitions).where(F.col("position") <= 2 * window_size)
    half = F.floor((F.col("position") - 1) / F.lit(window_size)).cast("int")
    counts = p.groupBy("actor", half.alias("half"), "dst").agg(F.count(F.lit(1)).alias("c"))
    h = counts.groupBy("actor", "half").agg(
        (F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("h"), F.sum("c").alias("n"))
    return (h.groupBy("actor").agg(
        F.max(F.when(F.col("half") == 0, F.col("h"))).alias("h1"),
        F.max(F.when(F.col("half") == 1, F.col("h"))).alias("h2"), F.sum("n").alias("n"))
        .where(F.col("n") >= 2 * window_size)
        .select("actor", ((F.col("h2") - F.col("h1")) / window_size).alias("entropy_rate")))


def transitions_per_actor(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("actor").agg(F.count(F.lit(1)).alias("n_transitions"))


def pseudonymize(transitions: DataFrame, seed: int, jitter_seconds: float = 30.0) -> DataFrame:
    """Keyed hashes for actors and resources, opaque action tokens, small fixed time shifts.

    Only (t, actor, src, dst, action) come out. Tokens number the distinct
    action types, a small vocabulary, in alphabetical order.
    """
    salt = X.seed_salt(seed)
    token = F.format_string("T%03d", F.row_number().over(Window.orderBy("action")))
    tokens = transitions.select("action").distinct().withColumn("_token", token)
    hashed = lambda c: F.substring(X.hmac_hex(F.col(c), salt), 1, 16).alias(c)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "actor", F.round(F.col("t") * 1000).cast("long")).cast("binary"))
    unit = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))
    return null_safe_join(transitions, tokens, ["action"]).select(
        (F.col("t") + (unit * 2 - 1) * jitter_seconds).alias("t"), hashed("actor"), hashed("src"), hashed("dst"),
        F.col("_token").alias("action"))
