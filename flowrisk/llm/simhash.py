"""Operator 3: SimHash near-duplicates, found by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import byte_words, text_slices
from flowrisk.llm.components import components
from flowrisk.session import materialize

BITS = 64
SEED = 42
SHINGLE = 4
DISTANCE = 4


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes, as a signed 64-bit number; 0 without words."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    hashes = [xxh64_intdigest(joined[s:e - 1], SEED) for s, e in zip(starts, starts[width:])]
    bits = np.unpackbits(np.array(hashes, ">u8").view("u1").reshape(-1, 8), axis=1)
    counts = np.add.reduce(bits, axis=0, dtype="int64")
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every whole text; null and blank texts have fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            found = [fingerprint(byte_words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["__id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


class Ring:
    """Segments of the 64 bits on a ring, and the budget of every chain of consecutive segments.

    If all segments together differ in at most ``most`` bits, there is a segment from which each chain
    of l segments differs in at most l * most / segments bits. With one segment more than ``most``
    the first segment of that chain is equal and the first two differ in one bit at most.
    """

    def __init__(self, most: int = DISTANCE):
        self.most, self.m = most, most + 1
        cuts = [round(BITS * i / self.m) for i in range(self.m + 1)]
        self.at = cuts[:-1]
        self.width = [b - a for a, b in zip(cuts, cuts[1:])]

    def segment(self, fp: Column, i: int) -> Column:
        i %= self.m
        return F.shiftrightunsigned(fp, self.at[i]).bitwiseAND(F.lit((1 << self.width[i]) - 1).cast("long"))

    def chain_holds(self, a: Column, b: Column, start: Column) -> Column:
        """Whether every chain from ``start`` keeps within its budget."""
        differ = [F.bit_count(self.segment(a, i).bitwiseXOR(self.segment(b, i))) for i in range(self.m)]

        def from_start(s: int) -> Column:
            total, holds = F.lit(0), F.lit(True)
            for n in range(1, self.m + 1):
                total = total + differ[(s + n - 1) % self.m]
                holds = holds & (total <= n * self.most // self.m)
            return holds

        test = F.when(start == 0, from_start(0))
        for s in range(1, self.m):
            test = test.when(start == s, from_start(s))
        return test

    def keys(self, fps: DataFrame) -> DataFrame:
        """(key, start, fp, exact): the first two segments of every chain, and those with one set bit cleared.

        Two fingerprints whose chain begins within its budgets meet in a key, one of them with its own
        segments: the second segments are equal, or one has the single bit that the other lacks.
        """
        fp, options = F.col("fp"), []
        for i in range(self.m):
            first, second, width = self.segment(fp, i), self.segment(fp, i + 1), self.width[(i + 1) % self.m]
            head = F.shiftleft(F.lit(i).cast("long") * (1 << self.width[i]) + first, width)

            def option(low: Column, exact: bool, head: Column = head, i: int = i) -> Column:
                return F.struct((head + low).alias("key"), F.lit(i).alias("start"), F.lit(exact).alias("exact"))

            options.append(option(second, True))
            for b in range(width):
                bit = F.lit(1 << b).cast("long")
                options.append(F.when(second.bitwiseAND(bit) != 0, option(second - bit, False)))
        every = fps.select("fp", F.explode(F.array(*options)).alias("k")).where("k is not null")
        return every.select("fp", "k.*")


def link(fps: DataFrame, most: int = DISTANCE) -> DataFrame:
    """(fp, component) of distinct fingerprints that reach another one by links of at most ``most`` bits.

    Bucket members that are near the bucket's first fingerprint are linked to it, not to one another; only
    members that are still in different components are then compared in pairs. A large group of near
    copies thus costs links in proportion to its members, and no link between components is missed.
    Joins whose sides grow with the input sort and merge: Spark takes the keys for as large as the fingerprints they are exploded from,
    some 36 times too small, and would broadcast them.
    """
    ring = Ring(most)
    keyed = ring.keys(fps)
    heads = keyed.groupBy("key").agg(F.min(F.when(F.col("exact"), F.col("fp"))).alias("head"), F.count("*").alias("n"))
    heads = heads.where("n > 1 and head is not null")
    members = materialize(keyed.join(heads.hint("merge"), "key"), "simhash-members")
    near = ring.chain_holds(F.col("fp"), F.col("head"), F.col("start")) & (distance(F.col("fp"), F.col("head")) <= most)
    linked = members.where("fp <> head").where(near).select(F.col("fp").alias("u"), F.col("head").alias("v")).distinct()
    found = materialize(components(linked), "simhash-found")

    # Buckets of two are settled. In others, whatever is not in one component yet is compared.
    open_ = members.where("n > 2").join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select(
        "key", "start", "fp", "exact", F.coalesce("component", "fp").alias("c"))
    mixed = open_.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    open_ = materialize(open_.join(mixed, "key"), "simhash-open")
    a, b = open_.where("exact").alias("a"), open_.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") != F.col("b.c")) &
                 (~F.col("b.exact") | (F.col("a.fp") < F.col("b.fp"))) & (distance(F.col("a.fp"), F.col("b.fp")) <= most) &
                 ring.chain_holds(F.col("b.fp"), F.col("a.fp"), F.col("a.start")))
    rest = materialize(met.select(F.col("a.c").alias("u"), F.col("b.c").alias("v")).distinct(), "simhash-rest")
    joined = components(rest).select(F.col("node").alias("component"), F.col("component").alias("final"))
    # A component of the first pass may be one fingerprint that no link had reached.
    every = found.unionByName(rest.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(
        found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return every.join(joined, "component", "left").select(F.col("node").alias("fp"), F.coalesce("final", "component").alias("component"))


def near_duplicates(docs: DataFrame, most: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SimHash component of every document: one row per input row.

    Columns: id, fingerprint (16 hex digits), component_id (smallest id reachable over fingerprints that
    differ in at most ``most`` bits, its own included; nulls are passed over). Null, empty and blank texts
    have fingerprint zero, which links like any other. Repeated rows give repeated results; other
    columns are ignored. Copies are reduced to one fingerprint before any comparison, and only ids and
    fingerprints are shuffled.
    """
    marked = materialize(fingerprints(docs, id_col, text_col), "simhash-fps")
    fps = materialize(marked.groupBy("fp").agg(F.min("__id").alias("least")), "simhash-distinct")
    linked = materialize(link(fps.select("fp"), most), "simhash-linked")
    grouped = fps.join(linked.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                           "component_id")
