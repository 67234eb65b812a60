"""Sanctioned patterns, trigger chains and the discount they earn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk import config as C
from flowrisk.functions import expressions as X
from flowrisk.operators.world import WINDOW_KEY, best_provenance
from flowrisk.session import materialize

JOB_PATH = r"^projects/[^/]+/locations/[^/]+/jobs/[^/]+$"
CHUNK = 4096


def enrich_provenance(events: DataFrame, known: DataFrame) -> DataFrame:
    """Level and source of provenance from the trigger reference and known initiators."""
    marked = events.join(known.select("actor_id").distinct().withColumn("_known", F.lit(True)),
                         "actor_id", "left")
    has = F.col("trigger_ref").isNotNull()
    return (marked.withColumn("provenance_level", F.when(has, "WEAK").otherwise("NONE"))
            .withColumn("provenance_source", X.provenance_source(
                F.col("actor_id"), F.col("trigger_ref"), F.coalesce("_known", F.lit(False))))
            .select(*dict.fromkeys([*events.columns, "provenance_level", "provenance_source"])))


def dominant_provenance(events: DataFrame) -> DataFrame:
    """Strongest provenance level per (window, actor) with its trigger reference, earliest first."""
    return (events.groupBy(*WINDOW_KEY).agg(best_provenance().alias("b"))
            .select(*WINDOW_KEY, F.col("b.provenance_level").alias("provenance_level"),
                    F.col("b.trigger_ref").alias("trigger_ref")))


def trigger_chains(refs: DataFrame, events: DataFrame, known: DataFrame) -> DataFrame:
    """Resolve each distinct trigger reference of ``refs``.

    A scheduler reference resolves when any known initiator is a scheduler
    account. A job path resolves when at least two events carry it. Both end at
    the first hop.
    """
    ref = F.col("trigger_ref")
    scheduler = (known.where(F.col("actor_id").endswith(C.SCHEDULER_ACCOUNT_SUFFIX))
                 .agg(F.min("actor_id").alias("_scheduler")))
    seen = (events.where(ref.isNotNull()).groupBy("trigger_ref")
            .agg(F.count(F.lit(1)).alias("corroboration")))
    # ``scheduler`` is a global aggregate: exactly one row.
    found = (refs.where(ref.isNotNull() & (ref != "")).select("trigger_ref").distinct()
             .join(seen, "trigger_ref", "left")
             .join(F.broadcast(scheduler), F.lit(True)))
    by_scheduler = ref.startswith("sched:") & F.col("_scheduler").isNotNull()
    by_job = ~ref.startswith("sched:") & ref.rlike(JOB_PATH) & (F.coalesce("corroboration", F.lit(0)) >= 2)
    return found.select(
        "trigger_ref", F.coalesce("corroboration", F.lit(0)).alias("corroboration"),
        (by_scheduler | by_job).alias("resolved"), F.lit(1).alias("depth"),
        F.when(by_scheduler, F.col("_scheduler"))
        .when(by_job, F.concat(F.lit("scheduler-job:"), F.element_at(F.split(ref, "/"), -1)))
        .alias("terminal_initiator"))


# --- pattern registry: a table in, a table out -------------------------------

def active_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.where("active")


def deactivate_pattern(patterns: DataFrame, pattern_id: str) -> DataFrame:
    return patterns.withColumn("active", F.col("active") & (F.col("pattern_id") != pattern_id))


def register_pattern(patterns: DataFrame, new: DataFrame) -> DataFrame:
    """Add patterns that carry a fresh id; known ids stay as they are."""
    stamped = new.withColumn("active", F.lit(True))
    return patterns.unionByName(stamped.join(patterns.select("pattern_id"), "pattern_id", "left_anti"),
                                allowMissingColumns=True)


# --- pattern match ------------------------------------------------------------

def actor_match(actor: Column, expected: Column) -> Column:
    """1 for an exact name, 0.8 for the same local part; the first hit in list order counts."""
    local = lambda c: F.substring_index(c, "@", 1)
    grade = F.transform(F.filter(expected, lambda e: e != ""),
                        lambda e: F.when(e == actor, 1.0).when(local(e) == local(actor), 0.8).otherwise(0.0))
    first = F.get(F.filter(grade, lambda g: g > 0), F.lit(0))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, 1.0).otherwise(F.coalesce(first, F.lit(0.0)))


def time_match(window_start: Column, expected: str | Column) -> Column:
    """Weekday (Monday is 0) in the list and hour in [start, end)."""
    expected = F.col(expected) if isinstance(expected, str) else expected
    day = F.coalesce(F.array_contains(expected["days_of_week"], F.weekday(window_start)), F.lit(True))
    hour = F.hour(window_start)
    inside = ((hour >= F.coalesce(expected["hour_start"], F.lit(0))) &
              (hour < F.coalesce(expected["hour_end"], F.lit(24))))
    return F.when(expected.isNull(), 1.0).when(day & inside, 1.0).otherwise(0.0)


def rate_match(count: Column, low: Column, high: Column) -> Column:
    return F.when((low <= 0) & (high <= 0), 1.0).when(count.between(low, high), 1.0).otherwise(0.0)


def zone_chunks(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Zones of each (window, actor) in arrays of ``chunk`` positions, written once."""
    chunks = (sequences.withColumn("_chunk", F.expr(f"(position - 1) div {chunk}"))
              .groupBy(*WINDOW_KEY, "_chunk")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "target_zone"))),
                               lambda r: r["target_zone"]).alias("_zones")))
    return materialize(chunks, "chunks")


def _alone(chunk: int) -> Column:
    """A first chunk that is not full is the whole sequence: one vector gives its score, and it is not grouped again."""
    return (F.col("_chunk") == 0) & (F.size("_zones") < chunk)


def zone_match(sequences: DataFrame, patterns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """LCS ratio of each (window, actor) zone sequence against each pattern with zones.

    ``sequences`` holds one row per position. Positions are grouped in chunks of
    fixed length, so no array outgrows ``chunk``; a sequence of several chunks
    is put together exactly from the segment tables of its chunks.
    """
    return _chunk_scores(zone_chunks(sequences, chunk), patterns, chunk)


def _chunk_scores(chunks: DataFrame, patterns: DataFrame, chunk: int) -> DataFrame:
    length = F.size("expected_zones")
    zoned = patterns.where(F.coalesce(length, F.lit(0)) > 0).select("pattern_id", length.alias("_m"), "expected_zones")
    m = F.col("_m")
    alone = _alone(chunk)

    def scores(part: DataFrame, symbols, one, several, value, joined) -> DataFrame:
        """LCS ratios with the patterns of ``part``, kept as bit vectors or as rows of numbers."""
        read = X.lcs_masks(F.col("_zones"), F.col("_table"))
        tables = (chunks.join(F.broadcast(part.select("pattern_id", "_m", symbols(F.col("expected_zones")).alias("_table"))), F.lit(True))
                  .withColumn("_read", read).withColumn("_n", F.size("_zones")))
        ratio = lambda lcs: (lcs / F.greatest(F.col("_n"), m)).alias("zone_score")
        single = tables.where(alone).select(*WINDOW_KEY, "pattern_id", ratio(value(one(F.col("_read"), m), m)))
        whole = (tables.where(~alone).select(*WINDOW_KEY, "pattern_id", "_m", "_chunk", "_n", several(F.col("_read"), m).alias("_vectors"))
                 .groupBy(*WINDOW_KEY, "pattern_id", "_m")
                 .agg(F.sum("_n").alias("_n"),
                      F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_vectors"))),
                                  lambda r: r["_vectors"]).alias("_chunks")))
        lcs = F.when(F.size("_chunks") == 1, value(F.get(F.get("_chunks", F.lit(0)), F.lit(0)), m)).otherwise(joined(F.col("_chunks"), m))
        return single.unionByName(whole.select(*WINDOW_KEY, "pattern_id", ratio(lcs)))

    short = scores(zoned.where(m <= X.WORD_BITS), X.symbol_masks, X.lcs_vector, X.lcs_vectors, X.lcs_of_vector, X.lcs_join)
    long = scores(zoned.where(m > X.WORD_BITS), X.last_positions, X.lcs_row, X.lcs_rows, lambda row, n: F.get(row, n), X.lcs_rows_join)
    return short.unionByName(long)


def _expected(active: DataFrame) -> DataFrame:
    """One row with all patterns, which are few, and the tables that read a zone sequence."""
    zones, m = F.col("expected_zones"), F.coalesce(F.greatest(F.size("expected_zones"), F.lit(0)), F.lit(0))
    row = F.struct("pattern_id", "registered_ts", "expected_actors", "expected_window", "rate_min", "rate_max", m.alias("m"),
                   F.when(m.between(1, X.WORD_BITS), X.symbol_masks(zones)).alias("masks"),
                   F.when(m > X.WORD_BITS, X.last_positions(zones)).alias("lasts"))
    return active.agg(F.collect_list(row).alias("_patterns")).where(F.size("_patterns") > 0)


def _ratio(zones: Column, p: Column) -> Column:
    """LCS ratio of a whole zone sequence with one of the patterns; null without zones on either side."""
    m = p["m"]
    short = X.lcs_of_vector(X.lcs_vector(X.lcs_masks(zones, p["masks"]), m), m)
    long = F.get(X.lcs_row(X.lcs_masks(zones, p["lasts"]), m), m)
    return F.when(zones.isNotNull() & (m > 0), F.when(m <= X.WORD_BITS, short).otherwise(long) / F.greatest(F.size(zones), m))


def pattern_match(windows: DataFrame, sequences: DataFrame, patterns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Best sanctioned pattern per (window, actor): score and id, null where nothing matches.

    ``windows`` needs ``event_count``. On equal scores the newest pattern wins. A window meets all patterns in one row;
    only sequences of several chunks are put together first.
    """
    active = active_patterns(patterns)
    chunks = zone_chunks(sequences, chunk)
    joined = _chunk_scores(chunks.where(~_alone(chunk)), active, chunk).groupBy(*WINDOW_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("pattern_id", "zone_score"))).alias("_ratios"))
    pairs = (windows.select(*WINDOW_KEY, "event_count")
             .join(chunks.where(_alone(chunk)).select(*WINDOW_KEY, "_zones"), WINDOW_KEY, "left")
             .join(joined, WINDOW_KEY, "left")
             .join(F.broadcast(_expected(active)), F.lit(True)))
    return _with_best(pairs).select(*WINDOW_KEY, *MATCH)


def row_match(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """:func:`pattern_match` of ``world.window_rows``, which keep their columns; a row has its sequence, so nothing is joined but the patterns."""
    pairs = (rows.withColumn("_zones", F.transform("acts", lambda a: a["target_zone"])).withColumn("event_count", F.size("acts"))
             .withColumn("_ratios", F.lit(None).cast("map<string,double>"))
             .join(F.broadcast(_expected(active_patterns(patterns))), F.lit(True), "left"))
    return _with_best(pairs).select(*rows.columns, *MATCH)


MATCH = ["pattern_match_score", "matched_pattern_id"]


def _with_best(pairs: DataFrame) -> DataFrame:
    w = C.PATTERN_WEIGHTS

    def score(p: Column) -> Column:
        zone = F.coalesce(_ratio(F.col("_zones"), p), F.try_element_at("_ratios", p["pattern_id"]), F.lit(1.0))
        return (w["actor"] * actor_match(F.col("actor_id"), p["expected_actors"]) + w["zone"] * zone +
                w["time"] * time_match(F.col("window_start"), p["expected_window"]) +
                w["rate"] * rate_match(F.col("event_count"), p["rate_min"], p["rate_max"]))

    best = F.array_max(F.transform("_patterns", lambda p: F.struct(
        score(p).alias("_score"), p["registered_ts"].alias("registered_ts"), p["pattern_id"].alias("pattern_id"))))
    return pairs.withColumn("b", best).withColumns({
        "pattern_match_score": F.col("b._score"), "matched_pattern_id": F.when(F.col("b._score") > 0, F.col("b.pattern_id"))})


def pattern_usage(matches: DataFrame) -> DataFrame:
    """Windows in which each pattern matched, and the last one."""
    return (matches.where(F.col("matched_pattern_id").isNotNull())
            .select(F.col("matched_pattern_id").alias("pattern_id"), "window_start").distinct()
            .groupBy("pattern_id")
            .agg(F.count(F.lit(1)).alias("match_count"), F.max("window_start").alias("last_matched_ts")))


def residual_risk(scores: DataFrame, matches: DataFrame, provenance: DataFrame,
                  chains: DataFrame) -> DataFrame:
    """Fusion score less the discount for explained activity."""
    explained = matches.join(provenance, WINDOW_KEY, "full")
    return discounted(scores, explained, chains)


def discounted(scores: DataFrame, explained: DataFrame, chains: DataFrame) -> DataFrame:
    """:func:`residual_risk` where matches and provenance are one row per (window, actor)."""
    multiplier = F.lit(0.0)
    for level, value in C.PROVENANCE_MULTIPLIERS.items():
        multiplier = F.when(F.col("provenance_level") == level, value).otherwise(multiplier)
    resolved = F.coalesce("resolved", F.lit(False))
    effective = F.when((F.col("provenance_level") == "WEAK") & resolved,
                       C.WEAK_RESOLVED_MULTIPLIER).otherwise(multiplier)
    return (scores.drop("provenance_level")
            .join(explained, WINDOW_KEY, "left")
            .join(chains.select("trigger_ref", "resolved"), "trigger_ref", "left")
            .withColumn("trigger_chain_resolved", resolved)
            .withColumn("residual_risk", F.col("fusion_raw") * (
                1 - C.DISCOUNT_WEIGHT * F.coalesce("pattern_match_score", F.lit(0.0)) * effective))
            .drop("resolved", "trigger_ref"))
