"""Operator 10: near-duplicate embeddings by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.components import components
from flowrisk.session import materialize

COSINE = 0.98
TABLES = 6
HASHES = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """``tables`` keys of ``hashes`` cross-polytope values each: the signed axis nearest to a rotated vector.

    A rotation is three rounds of random signs and a Hadamard transform. The probes of a key replace one
    of its values by the second nearest axis.
    """

    def __init__(self, dim: int, tables: int = TABLES, hashes: int = HASHES, seed: int = 10):
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.tables, self.hashes = tables, hashes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.size))

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own keys (rows, tables) and probes (rows, tables, hashes) of unit vectors."""
        x = np.pad(x, ((0, 0), (0, self.size - x.shape[1])))
        own = np.zeros((len(x), self.tables), "int64")
        probes = np.zeros((len(x), self.tables, self.hashes), "int64")
        for t in range(self.tables):
            first, second = [], []
            for k in range(self.hashes):
                y = x
                for signs in self.signs[t, k]:
                    y = hadamard(y * signs)
                best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
                value = 2 * best + (np.take_along_axis(y, best, 1) < 0)
                first.append(value[:, 0])
                second.append(value[:, 1])
            scale = [(2 * self.size) ** k for k in range(self.hashes)]
            own[:, t] = sum(v * s for v, s in zip(first, scale))
            for k in range(self.hashes):
                probes[:, t, k] = own[:, t] + (second[k] - first[k]) * scale[k]
        return own, probes


def bucket_rows(classes: DataFrame, tables: int, hashes: int) -> DataFrame:
    """(table, label, dim, bucket, cls, own) of every class: its own buckets and those it probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, CrossPolytope] = {}
        for batch in batches:
            cls, label = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            lengths = np.diff(np.asarray(batch.column(2).offsets))
            flat = np.asarray(batch.column(2).flatten(), "float64")
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                family = made.setdefault(dim, CrossPolytope(dim, tables, hashes))
                own, probes = family.keys(x)
                each = np.concatenate([own[:, :, None], probes], axis=2)
                n, _, width = each.shape
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.repeat(np.arange(tables, dtype="int32"), width), n)),
                    pa.array(np.repeat(label[rows], tables * width)), pa.array(np.full(n * tables * width, dim, "int32")),
                    pa.array(each.reshape(-1)), pa.array(np.repeat(cls[rows], tables * width)),
                    pa.array(np.tile(np.arange(width) == 0, n * tables)),
                ], ["table", "label", "dim", "bucket", "cls", "own"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("cls", "label", "vector").mapInArrow(
        run, f"table int, label {kind}, dim int, bucket long, cls long, own boolean")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links and component of every vector: one row per input row.

    Columns: id, n_links (other rows linked directly), component_id (smallest id reachable), kept (whether
    that is its own id). Rows link if their labels are equal and not null and their cosine is ``cosine`` at
    least. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as
    do vectors of another length. Equal vectors of a label are one class until the end, so copies
    are counted and not paired. Candidates meet in a bucket of any table, own or probed; every candidate is verified in
    double precision, and no bucket is capped.
    """
    v = F.col(vector_col)
    usable = F.coalesce(F.col(label_col).isNotNull() & F.exists(v, lambda x: x != 0) &
                        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("__id"), F.when(usable, F.col(label_col)).alias("label"),
                          F.when(usable, F.transform(v, lambda x: x.cast("double"))).alias("vector"))
    classes = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("__id").alias("least"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    buckets = materialize(bucket_rows(classes, tables, hashes), "vector-buckets")
    key = ["table", "label", "dim", "bucket"]
    met = buckets.where("own").select(*key, F.col("cls").alias("x")).join(buckets.select(*key, F.col("cls").alias("y")), key)
    pairs = met.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = F.transform("vector", lambda x: x / F.col("top"))  # keeps squares within range
    plain = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    units = classes.withColumn("top", largest).select("cls", "n", scaled.alias("u"))
    units = units.withColumn("norm", F.sqrt(plain(F.transform("u", lambda x: x * x))))
    side = lambda c: units.select(F.col("cls").alias(c), F.col("u").alias(f"u{c}"), F.col("norm").alias(f"norm{c}"), F.col("n").alias(f"n{c}"))
    dot = plain(F.zip_with("ux", "uy", lambda p, q: p * q))
    verified = pairs.join(side("x"), "x").join(side("y"), "y").where(dot / (F.col("normx") * F.col("normy")) >= cosine)
    links = materialize(verified.select("x", "y", "nx", "ny"), "vector-links")

    degree = links.select(F.col("x").alias("cls"), F.col("ny").alias("more")).unionByName(
        links.select(F.col("y").alias("cls"), F.col("nx").alias("more"))).groupBy("cls").agg(F.sum("more").alias("more"))
    found = components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))).withColumnRenamed("node", "cls")
    whole = classes.join(degree, "cls", "left").join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = whole.join(least, "component").select("label", "vector", "component_id", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.join(whole, ["label", "vector"], "left")
    component = F.when(F.col("vector").isNull(), F.col("__id")).otherwise(F.col("component_id"))
    return out.select(F.col("__id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))
