"""Ordered operations that survive one key holding most of the rows.

A plain window ``PARTITION BY actor ORDER BY ts`` sends every row of an actor
to one task. Here each key is cut into slices (usually time slices). The work
inside a slice is an ordinary window over (key, slice); what has to travel
between slices is one small row per (key, slice), carried along by a second
window over that summary. Results are those of the plain window.

Slices must follow the row order: a row of a later slice never sorts before a
row of an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.session import materialize, measured


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` so that null meets null; the keys come from the left."""
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


#: So many rows of one key may be one task's; larger keys are cut into slices.
CROWDED = 100_000


def crowded_keys(df: DataFrame, keys: list[str], most: int = CROWDED) -> DataFrame:
    """Keys with more than ``most`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys)


def slice_crowded(df: DataFrame, keys: list[str], slice_by: Column | None, step, crowded: DataFrame | None = None,
                  most: int = CROWDED) -> DataFrame:
    """``step(rows, slice_by)``, in which only crowded keys are cut into slices.

    Where most keys have a few rows in a slice, the rows that carry state from slice to slice are as many as the rows themselves.
    ``crowded`` gives the keys if they are known. They are written first, are at most rows / ``most`` in number and so are broadcast;
    ``df`` is read again and should be cheap.
    """
    if slice_by is None:
        return step(df, None)
    crowded = materialize(crowded_keys(df, keys, most) if crowded is None else crowded.select(*keys), "crowded")
    if crowded.isEmpty():
        return step(df, None)
    marked = null_safe_join(df, F.broadcast(crowded.withColumn("_crowded", F.lit(True))), keys, "left")
    few, many = (marked.where(c).drop("_crowded") for c in (F.col("_crowded").isNull(), F.col("_crowded").isNotNull()))
    return step(few, None).unionByName(step(many, slice_by))


def _reverse(order: list[str]) -> list[Column]:
    return [F.col(c).desc() for c in order]


def nearest_value(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                  slice_by: Column | None = None, forward: bool = False,
                  include_current: bool = False) -> DataFrame:
    """Add the closest non-null ``value`` before each row (or after it).

    Looking forward runs over descending order, because a frame that ends in
    "unbounded following" costs quadratic time in Spark.
    """
    upto = Window.currentRow if include_current else -1
    ordering = _reverse(order) if forward else [F.col(c) for c in order]
    if slice_by is None:
        w = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, upto)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))

    w = Window.partitionBy(*keys, "_slice").orderBy(*ordering)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (df.withColumn("_slice", slice_by)
           .withColumn("_value", value)
           .withColumn("_near", F.last("_value", ignorenulls=True)
                       .over(w.rowsBetween(Window.unboundedPreceding, upto)))
           .withColumn("_tail", F.last("_value", ignorenulls=True).over(running))
           .withColumn("_is_last", F.lead(F.lit(1)).over(w).isNull()))
    slice_order = F.col("_slice").desc() if forward else F.col("_slice")
    across = (Window.partitionBy(*keys).orderBy(slice_order)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = (cut.where("_is_last").select(*keys, "_slice", "_tail")
               .withColumn("_carry", F.last("_tail", ignorenulls=True).over(across))
               .select(*keys, "_slice", "_carry"))
    return (null_safe_join(cut, carried, [*keys, "_slice"], "left")
            .withColumn(name, F.coalesce("_near", "_carry"))
            .select(*df.columns, name))


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
                  slice_by: Column | None = None, forward: bool = False) -> DataFrame:
    """Add columns of the previous row (or the next one). ``values`` maps new name to source."""
    payload = F.struct(*[F.col(source).alias(new) for new, source in values.items()])
    out = nearest_value(df, keys, order, payload, "_row", slice_by, forward)
    return out.select(*df.columns, *[F.col(f"_row.{new}").alias(new) for new in values])


def with_next(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
              slice_by: Column | None = None) -> DataFrame:
    return with_previous(df, keys, order, values, slice_by, forward=True)


def running_totals(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column],
                   slice_by: Column | None = None) -> DataFrame:
    """Add the sum of each expression over all earlier rows, the current one left out."""
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = df.withColumn("_slice", F.lit(0) if slice_by is None else slice_by)
    for name, expression in totals.items():
        cut = cut.withColumn(f"_add_{name}", expression)
    local = cut
    for name in totals:
        local = local.withColumn(f"_in_{name}", F.sum(f"_add_{name}").over(w))
    if slice_by is None:
        return local.select(*df.columns, *[F.coalesce(f"_in_{n}", F.lit(0)).alias(n) for n in totals])
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys, "_slice").agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in totals])
    for name in totals:
        offsets = offsets.withColumn(f"_off_{name}", F.sum(f"_sum_{name}").over(across))
    offsets = offsets.select(*keys, "_slice", *[f"_off_{n}" for n in totals])
    zero = F.lit(0)
    return (null_safe_join(local, offsets, [*keys, "_slice"], "left")
            .select(*df.columns,
                    *[(F.coalesce(f"_in_{n}", zero) + F.coalesce(f"_off_{n}", zero)).alias(n)
                      for n in totals]))


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str = "position",
                  slice_by: Column | None = None) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    out = running_totals(df, keys, order, {name: F.lit(1)}, slice_by)
    return out.withColumn(name, F.col(name).cast("long") + 1)


def asof_lookup(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str,
                values: list[str], name: str, slice_by=None, forward: bool = False,
                strict: bool = False, tie_order: list[str] | None = None, most: int | None = None) -> DataFrame:
    """As-of join: add struct ``name`` with the closest right row at or before ``left_on``.

    ``forward`` looks at or after instead, ``strict`` leaves equal positions
    out. Both sides go into one ordered stream, so the cost is one sort per
    (key, slice) and never a product of the two sides. ``slice_by`` maps the
    ordering column to a slice number. Among right rows at one position the
    one sorting last by ``tie_order`` wins. With ``most`` only keys with more rows
    are cut into slices (see :func:`slice_crowded`).
    """
    tie_order = tie_order or []
    payload = F.struct(F.col(right_on).alias("at"), *[F.col(v) for v in values])
    # At equal positions a right row must precede the left row to be seen.
    right_first = 0 if (strict == forward) else 2
    r = right.select(*keys, F.col(right_on).alias("_at"), F.lit(right_first).alias("_side"),
                     *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie_order)],
                     payload.alias("_value"))
    packed = F.struct(*[F.col(c) for c in left.columns])
    left_row = left.select(*keys, F.col(left_on).alias("_at"), F.lit(1).alias("_side"),
                           packed.alias("_left"))
    stream = r.unionByName(left_row, allowMissingColumns=True)
    order = ["_at", "_side"] + [f"_tie{i}" for i in range(len(tie_order))]
    cut = None if slice_by is None else slice_by(F.col("_at"))
    step = lambda rows, piece: nearest_value(rows, keys, order, F.col("_value"), name, piece, forward)
    found = step(stream, cut) if most is None else slice_crowded(stream, keys, cut, step, most=most)
    return found.where(F.col("_left").isNotNull()).select("_left.*", name)


def _sign_and_exponent(v: Column) -> Column:
    """The leading bits of a number: never smaller for a larger one, not a number last."""
    size = lambda x: F.floor(F.log2(x)).cast("int") + 1100
    return (F.when(F.isnan(v), 3001).when(v == float("inf"), 3000).when(v == float("-inf"), -3000)
            .when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(0))


def _next_digit(v: Column, lo: Column, hi: Column, steps: int) -> Column:
    """The place of a number in equal steps from ``lo`` to ``hi``."""
    span = hi - lo
    return F.when((span > 0) & (span < float("inf")), F.least(F.lit(steps - 1), F.floor((v - lo) / span * steps).cast("int"))).otherwise(0)


def values_at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column],
                    bins: int = 4096, largest: int = 100_000) -> DataFrame:
    """Exact order statistics: one row per key with the value at each zero-based rank.

    ``ranks`` maps an output name to an expression over ``n``, the row count of
    the key; a null key is a key. Equal values are counted together. A selection by digits follows: the first pass counts
    values by sign and exponent, each further one splits the bins that hold a rank into ``bins`` steps between their smallest and
    largest value. Only those bins go on; one with a single value is done, and those with no more than ``largest`` different
    values are sorted. No task holds a group, whatever the spread of its values.
    """
    if not keys:
        whole = values_at_ranks(df.withColumn("_all", F.lit(0)), ["_all"], value, ranks, bins, largest)
        return whole.drop("_all")
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    rows = materialize(counted, "values").withColumn("_d", F.col("_v").cast("double"))
    path: list[str] = []
    wanted, done = None, []
    while True:
        digit = _next_digit(F.col("_d"), F.col("_lo").cast("double"), F.col("_hi").cast("double"), bins) if path else _sign_and_exponent(F.col("_d"))
        name = f"_b{len(path)}"
        rows = rows.withColumn(name, digit).select(*keys, *path, name, "_v", "_c", "_d")
        counts = rows.groupBy(*keys, *path, name).agg(F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_kinds"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        within = Window.partitionBy(*keys, *path)
        before = within.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
        if wanted is None:
            named = F.array(*[F.struct(F.lit(to).alias("_name"), rank.cast("long").alias("_rank")) for to, rank in ranks.items()])
            found = counts.withColumn("n", F.sum("_bc").over(within)).select("*", F.explode(named).alias("_want")).select("*", "_want.*").drop("_want")
        else:
            found = null_safe_join(counts, wanted, [*keys, *path])
        path = [*path, name]
        hit = found.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_bc")))
        hit = hit.select(*keys, *path, "n", "_name", (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi", "_kinds")
        # One row per key and rank; written, so that the passes do not grow into one plan.
        hit, state = measured(hit, "ranks", most=F.coalesce(F.max(F.when(F.col("_lo") != F.col("_hi"), F.col("_kinds"))), F.lit(0)))
        done.append(hit.where(F.col("_lo") == F.col("_hi")).select(*keys, "n", "_name", F.col("_lo").alias("_v")))
        if not state["most"]:
            break
        left = hit.where(F.col("_lo") != F.col("_hi"))
        wanted = left.select(*keys, *path, "n", "_name", "_rank")
        rows = null_safe_join(rows, left.select(*keys, *path, "_lo", "_hi").distinct(), [*keys, *path])
        if state["most"] <= largest:
            inside = Window.partitionBy(*keys, *path).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            last = null_safe_join(rows.withColumn("_upto", F.sum("_c").over(inside)), wanted, [*keys, *path])
            done.append(last.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))).select(*keys, "n", "_name", "_v"))
            break
    picked = done[0]
    for part in done[1:]:
        picked = picked.unionByName(part)
    return (picked.groupBy(*keys, "n")
            .agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks]))


def with_quantile_slice(df: DataFrame, keys: list[str], value: str, name: str, slices: int = 256) -> DataFrame:
    """Add a slice number of ``value`` within its key, with about equally many rows in each slice."""
    one = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    edges = rows.groupBy(*one).agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], slices * 20).alias("_edges"))
    cut = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return _one_row_join(rows, edges, one).select(*df.columns, cut.alias(name))


def linear_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation between neighbouring ranks."""
    ranks = {}
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(p)
        ranks[f"{name}_lo"] = F.floor(at)
        ranks[f"{name}_hi"] = F.ceil(at)
    got = values_at_ranks(df, keys, value, ranks)
    out = [*[F.col(k) for k in keys], F.col("n")]
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(p)
        out.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) *
                    (at - F.floor(at))).alias(name))
    return got.select(*out)


def _one_row_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join a per-key summary; the summary of the whole table is one row and is broadcast."""
    return left.join(F.broadcast(right), keys) if keys == ["_all"] else null_safe_join(left, right, keys)
