"""Operator 9: shards of equal bytes by sampled splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.llm.common import number_copies
from flowrisk.session import materialize

RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 64
ROWS_PER_CELL = 250_000
SNAP = 256


def _place(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below the key."""
    if not splitters:
        return F.lit(0)
    known = F.array(*(F.lit(s) for s in splitters))
    return F.size(F.filter(known, lambda s: s <= key))


def splitters(rows: DataFrame, ranges: int, samples: int) -> list[int]:
    """Boundaries of ``ranges`` key ranges with about equal sizes, from a size-weighted sample.

    A row is drawn with probability proportional to its size (``samples`` rows expected, so the list
    that reaches the driver has a fixed length whatever the input); every ``samples / ranges``-th
    drawn key is a boundary.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    draw = F.shiftrightunsigned(F.xxhash64("key", "__id", "copy", F.lit(9)), 11) / float(1 << 53)
    drawn = rows.where(draw * total < F.col("size") * samples).select("key")
    rank = F.percent_rank().over(Window.orderBy("key"))
    edges = (drawn.select("key", F.floor(rank * ranges).alias("range"))
             .groupBy("range").agg(F.min("key").alias("key")).where("range > 0").orderBy("key").collect())
    return sorted({e["key"] for e in edges})


def shard_rows(docs: DataFrame, shards: int = 8, rows_per_cell: int = ROWS_PER_CELL, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Deal all rows into ``shards`` shards of near equal bytes: one row per input row.

    Columns: id, size (UTF-8 bytes of the text plus 1, null text: 1), text_crc32 (null text: null),
    law (``bytes``), shard, slot (gapless from 0 within the shard), grown_shard (null: this law has no
    stable growth).

    Rows are ordered by the hash of their text and range-partitioned at boundaries from a size-weighted
    sample. A range with more than ``rows_per_cell`` rows is divided again, by equal steps of the key
    and, where one text fills a step, by the hash of the id, so no task sorts more than a small multiple
    of that. Exact sums over ranges then give every row its place in all bytes. Copies of a text stay in
    one shard unless they take over 1/256 of a shard. Only ids, hashes and sizes are shuffled.
    Rows that are alike in every respect are numbered first and dealt like different rows.
    """
    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).alias("__id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                         F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = materialize(number_copies(narrow, "copy"), "shard-rows")
    ranges = shards * RANGES_PER_SHARD
    edges = splitters(rows, ranges, ranges * SAMPLES_PER_RANGE)
    ranged = rows.withColumn("range", _place(F.col("key"), edges))

    # Overfull ranges: first by steps of the key, then by the hash of the id.
    spread = ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    spread = spread.select("range", "lo", (F.col("hi").cast("double") - F.col("lo").cast("double") + 1.0).alias("width"),
                           F.ceil(F.col("n") / rows_per_cell).alias("steps"))
    stepped = ranged.join(F.broadcast(spread), "range").withColumn(
        "step", F.floor((F.col("key").cast("double") - F.col("lo").cast("double")) / F.col("width") * F.col("steps")))
    full = stepped.groupBy("range", "step").agg(F.ceil(F.count("*") / rows_per_cell).alias("parts"))
    full = full.where("parts > 1")  # one row per `rows_per_cell` rows at most
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("__id", "copy", F.lit(5)), F.col("parts")))
    celled = stepped.join(full, ["range", "step"], "left").withColumn("part", part)
    cell = ["range", "step", "part"]
    celled = celled.select(*cell, "key", "__id", "copy", "size", "text_crc32", F.col("parts").isNotNull().alias("split"))

    # The place of every cell in all bytes and rows: one row per cell.
    sums = celled.groupBy(*cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*cell, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_at"),
                          F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_at"),
                          F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy(*cell).orderBy("key", "__id", "copy")
    text_group = Window.partitionBy(*cell, "key")
    placed = celled.withColumns({
        "start": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
        "row": F.row_number().over(inside).cast("long") - 1})
    placed = placed.withColumns({"group_bytes": F.sum("size").over(text_group), "group_start": F.min("start").over(text_group)})
    placed = placed.join(offsets, cell)
    whole = ~F.col("split") & (F.col("group_bytes") * shards * SNAP <= F.col("total"))
    twice_middle = F.when(whole, 2 * (F.col("byte_at") + F.col("group_start")) + F.col("group_bytes")).otherwise(
        2 * (F.col("byte_at") + F.col("start")) + F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(twice_middle.cast("decimal(38,0)") * shards / (2 * F.col("total")))).cast("int")
    placed = materialize(placed.select("__id", "size", "text_crc32", shard.alias("shard"),
                                       (F.col("row_at") + F.col("row")).alias("at")), "shard-places")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
