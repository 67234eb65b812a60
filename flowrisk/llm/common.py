"""Helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words everywhere in this package: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = 2_000
SLICE_BYTES = 16 << 20
COPIES = 4_096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case, as UTF-8. ``bytes`` methods touch ASCII only."""
    return (text or "").encode().lower().split()


def text_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = ARROW_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``rows`` rows and ``size`` bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            stop = max(at + 1, min(at + rows, most, batch.num_rows))
            yield batch.slice(at, stop - at)
            at = stop


def mapped_bytes(texts: pa.Array, change: Callable[[bytes], bytes]) -> pa.StringArray:
    """A column of texts, null as empty, after ``change`` of all their bytes, which keeps their number."""
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "<i4")[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "<i4")
    raw = change(data.slice(at[0], at[-1] - at[0]).to_pybytes()) if data else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype("<i4")), pa.py_buffer(raw))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space of a column of texts without nulls, and how many each text has."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    real = pc.not_equal(words, "")
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), np.diff(before[np.concatenate([[0], ends])])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def uniform(*cols: Column) -> Column:
    """A repeatable draw from [0, 1) for the given values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def number_copies(df: DataFrame, name: str) -> DataFrame:
    """Number equal rows from 0, so that a repeated row can be dealt out like different ones.

    Equal rows are counted before the shuffle, hence a row that fills a third of the
    table costs one record per task. They are numbered in runs of COPIES, dealt out over the tasks, so that no array holds them all.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    many = counted.where(F.col("__n") > COPIES).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES)))).repartition("__run")
    runs = counted.where(F.col("__n") <= COPIES).withColumn("__run", F.lit(0).cast("long")).unionByName(many)
    first = F.col("__run") * COPIES
    return runs.withColumn(name, F.explode(F.sequence(first, F.least(first + COPIES, F.col("__n")) - 1))).drop("__n", "__run")


def groups_for(rows: int, per_group: int) -> int:
    return max(1, -(-rows // per_group))


def sql_string(value: str) -> str:
    return "'" + re.sub("'", "''", value) + "'"
