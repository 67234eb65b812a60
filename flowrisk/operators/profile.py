"""Profiling JSON logs of unknown structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.functions import expressions as X
from flowrisk.operators.ordered import nearest_value
from flowrisk.session import materialize


def log_short_name(log_name: Column) -> Column:
    """The part after ``/logs/``; entries without a log name are UNKNOWN."""
    name = F.coalesce(log_name, F.lit("UNKNOWN"))
    return F.when(name.contains("/logs/"), F.element_at(F.split(name, "/logs/"), -1)).otherwise(name)


def with_log_type(entries: DataFrame, column: str = "entry") -> DataFrame:
    return entries.withColumn("log_type", log_short_name(F.get_json_object(column, "$.logName")))


def log_type_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("log_type").agg(F.count(F.lit(1)).alias("n"))


LEVELS = 4  # containers opened in one pass


def _opened(rows: DataFrame, keep: list[str], levels: int, array_items: int | None) -> DataFrame:
    """(keep..., path, v): what stands ``levels`` below the values ``v``, or higher where there is nothing to open."""
    spark = rows.sparkSession
    rows = rows.select(*keep, "path", "v", F.lit(True).alias("open"))
    for _ in range(levels):
        opened = rows.lateralJoin(
            spark.tvf.variant_explode_outer(F.when(F.col("open"), F.col("v")).outer())
            .select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_item")))
        if array_items is not None:
            opened = opened.where(F.col("_pos").isNull() | F.col("_key").isNotNull() | (F.col("_pos") < array_items))
        inside = F.col("_pos").isNotNull()
        path = (F.when(~inside, F.col("path")).when(F.col("_key").isNull(), F.concat("path", F.lit("[]")))
                .when(F.col("path") == "", F.col("_key")).otherwise(F.concat_ws(".", "path", "_key")))
        rows = opened.select(*keep, path.alias("path"), F.when(inside, F.col("_item")).otherwise(F.col("v")).alias("v"),
                             inside.alias("open"))
    return rows


def flatten_json(entries: DataFrame, column: str = "entry", keep: list[str] | None = None,
                 max_depth: int | None = None, array_items: int | None = None) -> DataFrame:
    """Leaf paths ``a.b[].c`` of every entry: (keep..., path, value, is_string).

    The entries are read once. A pass opens LEVELS levels of containers with ``variant_explode`` and writes what it
    finds; containers that are left go through another pass, until there is none. With ``max_depth``
    containers below it stay whole as JSON text. ``array_items`` reads only the first items of each array, as a
    sampling inspection does; by default all are read. Broken JSON, and empty containers, have no leaves.
    """
    keep = keep or []
    rows = entries.select(*keep, F.lit("").alias("path"), F.try_parse_json(column).alias("v"))
    done, parts = 0, []
    while True:
        levels = LEVELS if max_depth is None else min(LEVELS, max_depth - done)
        done += levels
        found = _opened(rows, keep, levels, array_items).where(F.col("v").isNotNull())
        kind = F.schema_of_variant("v")
        container = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
        text = F.when(container, F.to_json("v")).when(~F.is_variant_null("v"), F.try_variant_get("v", "$", "string"))
        leaves = found.select(*keep, "path", text.alias("value"), (kind == "STRING").alias("is_string"), container.alias("open"))
        # What is empty is told from the written text: a filter before the write would read kind and text of every value twice.
        full = ~F.col("value").isin("{}", "[]")
        if done == max_depth:
            parts.append(leaves.where(~F.col("open") | full).drop("open"))
            break
        leaves = materialize(leaves, "leaves")
        parts.append(leaves.where(~F.col("open")).drop("open"))
        left = leaves.where(F.col("open") & full)
        if left.isEmpty():
            break
        rows = left.select(*keep, "path", F.try_parse_json("value").alias("v"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def semantic_types(leaves: DataFrame) -> DataFrame:
    """Add the semantic type of string values."""
    return leaves.withColumn("value_type", F.when(F.col("is_string"), X.value_type(F.col("value"))))


def type_counts(leaves: DataFrame, name: str = "n") -> DataFrame:
    """Occurrences of each semantic type per path.

    Values without a type are left out after counting: a filter before it would try all patterns a second time.
    """
    return semantic_types(leaves).groupBy("path", "value_type").agg(F.count("value_type").alias(name)).where(F.col(name) > 0)


def value_counts(leaves: DataFrame) -> DataFrame:
    """Occurrences per (path, value): the shared first step of the statistics."""
    return (semantic_types(leaves).withColumn("value", F.coalesce("value", F.lit("")))
            .groupBy("path", "value", "value_type").agg(F.count(F.lit(1)).alias("c")))


def profile_fields(leaves: DataFrame, total_entries: DataFrame, samples: int = 5,
                   cardinality_cap: int | None = None) -> DataFrame:
    """Count, presence, cardinality, dominant semantic type and sample values per path.

    ``total_entries`` is one row with the number of entries. Samples are the
    smallest values, which makes the report repeatable. ``cardinality_cap``
    reports no more than that many distinct values.
    """
    counts = materialize(value_counts(leaves), "value-counts")
    per_type = (counts.where(F.col("value_type").isNotNull()).groupBy("path", "value_type").agg(F.sum("c").alias("c"))
                .groupBy("path").agg(F.min(F.struct((-F.col("c")).alias("n"), "value_type")).alias("t"))
                .select("path", F.col("t.value_type").alias("dominant_type")))
    by_value = counts.groupBy("path", "value").agg(F.sum("c").alias("c"))
    smallest = None
    if samples:
        # Partial top-n per task, then per path: never the whole value set.
        order = F.row_number().over(Window.partitionBy("path").orderBy("value"))
        smallest = (by_value.withColumn("_r", order).where(F.col("_r") <= samples).groupBy("path")
                    .agg(F.array_sort(F.collect_list("value")).alias("samples")))
    size = by_value.groupBy("path").agg(F.sum("c").alias("count"), F.count(F.lit(1)).alias("cardinality"))
    if cardinality_cap is not None:
        size = size.withColumn("cardinality", F.least("cardinality", F.lit(cardinality_cap)))
    out = (size.join(F.broadcast(total_entries.toDF("total_entries")), F.lit(True))
           .join(per_type, "path", "left")
           .withColumn("presence_rate", F.col("count") / F.col("total_entries"))
           .withColumn("cardinality_ratio", F.col("cardinality") / F.col("count")))
    return out if smallest is None else out.join(smallest, "path", "left")


SKETCH_BITS = 12  # 4,096 registers: a standard error of 1.04 / 64


def profile_sketch(leaves: DataFrame, samples: int = 5, bits: int = SKETCH_BITS) -> DataFrame:
    """A profile that can be merged: (path, count, values, types, samples), one row per path.

    ``values`` is an HLL sketch of the distinct values, ``types`` has the occurrences of each semantic type and ``samples`` the smallest values. Profiles of
    new files are merged (``merge_profiles``) with what is kept of the old ones, which are not read again.
    """
    return sketch_of_counts(materialize(leaf_counts(leaves), "leaf-counts"), samples, bits)


def leaf_counts(leaves: DataFrame) -> DataFrame:
    """(path, value, c, strings): occurrences of each distinct value, and as a string. One shuffle; what follows reads a value once, not a leaf."""
    return (leaves.withColumn("value", F.coalesce("value", F.lit(""))).groupBy("path", "value")
            .agg(F.count(F.lit(1)).alias("c"), F.count_if("is_string").alias("strings")))


def sketch_of_counts(counts: DataFrame, samples: int = 5, bits: int = SKETCH_BITS) -> DataFrame:
    """:func:`profile_sketch` of :func:`leaf_counts`, which should be written, as it is read twice."""
    kind = F.when(F.col("strings") > 0, X.value_type(F.col("value")))
    per_type = counts.groupBy("path", kind.alias("value_type")).agg(
        F.sum("c").alias("n"), F.sum("strings").alias("c"), F.hll_sketch_agg(F.concat(F.lit("="), "value"), bits).alias("values"))
    typed = F.when(F.col("value_type").isNotNull(), F.struct("value_type", "c"))
    flat = per_type.groupBy("path").agg(F.sum("n").alias("count"), F.hll_union_agg("values").alias("values"), F.collect_list(typed).alias("types"))
    order = F.row_number().over(Window.partitionBy("path").orderBy("value"))
    smallest = (counts.select("path", "value").withColumn("_r", order).where(F.col("_r") <= samples)
                .groupBy("path").agg(F.array_sort(F.collect_list("value")).alias("samples")))
    return flat.join(smallest, "path")


def merge_profiles(first: DataFrame, *others: DataFrame, samples: int = 5) -> DataFrame:
    """One mergeable profile of several. Counts, types and samples are exact, values as good as those of one sketch over everything."""
    every = first
    for other in others:
        every = every.unionByName(other)
    every = materialize(every, "profiles")
    flat = every.groupBy("path").agg(F.sum("count").alias("count"), F.hll_union_agg("values").alias("values"))
    kinds = (every.select("path", F.explode("types").alias("t")).groupBy("path", "t.value_type").agg(F.sum("t.c").alias("c"))
             .groupBy("path").agg(F.collect_list(F.struct("value_type", "c")).alias("types")))
    order = F.row_number().over(Window.partitionBy("path").orderBy("value"))
    smallest = (every.select("path", F.explode("samples").alias("value")).distinct().withColumn("_r", order).where(F.col("_r") <= samples)
                .groupBy("path").agg(F.array_sort(F.collect_list("value")).alias("samples")))
    return flat.join(kinds, "path", "left").join(smallest, "path")


def read_profile(sketch: DataFrame, total_entries: DataFrame) -> DataFrame:
    """The columns of ``profile_fields`` from a mergeable profile; cardinality is an estimate."""
    best = F.array_min(F.transform("types", lambda t: F.struct((-t["c"]).alias("n"), t["value_type"].alias("value_type"))))
    return (sketch.join(F.broadcast(total_entries.toDF("total_entries")), F.lit(True))
            .select("path", "count", F.hll_sketch_estimate("values").alias("cardinality"), best["value_type"].alias("dominant_type"), "samples", "total_entries")
            .withColumn("presence_rate", F.col("count") / F.col("total_entries"))
            .withColumn("cardinality_ratio", F.col("cardinality") / F.col("count")))


def timestamp_fields(profile: DataFrame) -> DataFrame:
    """Paths that look like times and of which a sample can be read as one."""
    named = F.lower("path").contains("time")
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
    readable = F.exists("samples", lambda v: v.rlike(iso) & X.parse_ts(v).isNotNull())
    return profile.where(((F.col("dominant_type") == "iso_timestamp") | named) & readable)


def actor_candidates(profile: DataFrame) -> DataFrame:
    return profile.where((F.col("dominant_type") == "email") & (F.col("cardinality") >= 1))


def target_candidates(profile: DataFrame) -> DataFrame:
    return profile.where((F.col("dominant_type") == "uri") & (F.col("cardinality") >= 1))


def correlation_candidates(profile: DataFrame) -> DataFrame:
    """Fields that group entries: neither constant nor unique, best at 30 % distinct."""
    ratio = F.col("cardinality_ratio")
    return (profile.where((ratio > 0.01) & (ratio < 0.8) & (F.col("cardinality") >= 2) & (F.col("count") >= 5))
            .withColumn("score", F.round(1.0 - F.abs(ratio - 0.3), 3)))


def temporal_clusters(timed: DataFrame, gap_seconds: float = 30.0, slice_seconds: int = 3600) -> DataFrame:
    """Give each entry (id, ts) the start of its burst; a longer gap than given starts a new one.

    There is no key to partition by, so the time line itself is cut in slices.
    """
    order = ["_us", "id"]
    rows = timed.where(F.col("ts").isNotNull()).withColumn("_us", F.unix_micros("ts"))
    piece = X.time_slice(F.col("ts"), slice_seconds)
    before = materialize(nearest_value(rows, [], order, F.col("_us"), "_prev", piece), "timed")
    fresh = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > int(gap_seconds * 1_000_000))
    marked = nearest_value(before, [], order, F.when(fresh, F.col("_us")), "_start", piece, include_current=True)
    return marked.select(*timed.columns, F.timestamp_micros("_start").alias("cluster_start"))


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    """Bursts of at least two entries."""
    return (clustered.groupBy("cluster_start").agg(F.max("ts").alias("cluster_end"), F.count(F.lit(1)).alias("n_entries"))
            .where(F.col("n_entries") >= 2))


def cluster_shared(leaves: DataFrame, clustered: DataFrame) -> DataFrame:
    """Paths with one single value within a burst; ``leaves`` and ``clustered`` share ``id``."""
    return _constant(leaves.join(clustered.select("id", "cluster_start"), "id"), clustered)


def cluster_shared_entries(entries: DataFrame, clustered: DataFrame, column: str = "entry") -> DataFrame:
    """:func:`cluster_shared` of the leaves of ``entries``.

    An entry is given its burst before it is opened, so that one row an entry is shuffled and not one a leaf; entries without one are not opened.
    """
    clustered = materialize(clustered, "clustered")
    marked = entries.join(clustered.select("id", "cluster_start"), "id")
    return _constant(flatten_json(marked, column, keep=["cluster_start"]), clustered)


def _constant(leaves: DataFrame, clustered: DataFrame) -> DataFrame:
    sizes = cluster_sizes(clustered)
    one = (leaves.where(F.col("value").isNotNull()).groupBy("cluster_start", "path").agg(F.min("value").alias("value"), F.max("value").alias("_hi"))
           .where(F.col("value") == F.col("_hi")).drop("_hi"))
    return one.join(sizes.select("cluster_start"), "cluster_start", "left_semi")


def cluster_keys(shared: DataFrame) -> DataFrame:
    """Paths constant within bursts but different between them."""
    return (shared.groupBy("path", "value").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("path").agg(F.count(F.lit(1)).alias("n_values"), F.sum("c").alias("n_clusters"))
            .where(F.col("n_values") >= 2).withColumn("score", F.lit(0.9)))


def cross_log_overlap(leaves: DataFrame) -> DataFrame:
    """Shared string values between fields of different log types.

    Per value only the distinct (log type, path) places are kept, a number
    bounded by the structure of the logs and not by their size.
    """
    places = (leaves.where(F.col("is_string") & (F.length("value") > 3))
              .select("log_type", "path", "value").distinct())
    per_value = (places.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("log_type", "path"))).alias("at"))
                 .where(F.size("at") > 1))
    # Values that occur in the same places are counted before pairs are formed.
    grouped = per_value.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    pairs = (grouped.select("n", F.col("at").alias("_all"), F.explode("at").alias("a"))
             .select("n", "a", F.explode("_all").alias("b")).where(F.col("a.log_type") < F.col("b.log_type")))
    return (pairs.groupBy(F.col("a.log_type").alias("log_type_1"), F.col("a.path").alias("field_1"),
                          F.col("b.log_type").alias("log_type_2"), F.col("b.path").alias("field_2"))
            .agg(F.sum("n").alias("shared_values")))
