"""Operator 11: spelling variants, by scans of sorted word lists with banded edit-matrix rows."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import groups_for
from flowrisk.session import materialize

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5            # times that a form is more frequent than its variant
TYPOS = 199
CACHE_WORDS = 300_000
BUCKET_WORDS = 2_048  # larger buckets are split by one more part of their words
TASK_ROWS = 20_000
# What each byte of Latin-1 becomes: A-Z in lower case, letters as they are, all else a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
OVER = 9             # an edit count beyond any that matters


def spelled(doc_id: object, run: bytes) -> bytes:
    """The word of a run (Latin-1): one letter less where the hash of id and run says so. A null id is an empty one."""
    return _spelled(zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), run)


def _spelled(prefix: int, run: bytes) -> bytes:
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % TYPOS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least LEAST_LENGTH letters that occur LEAST_COUNT times or more, over all texts; null texts have none."""
    def flushed(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total]), pa.array(total.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # Letters are in Latin-1; what is not in it separates words like any other character.
                for word, k in Counter((text or "").encode("latin-1", "replace").translate(LETTERS).split()).items():
                    if len(word) >= LEAST_LENGTH and len(word := _spelled(prefix, word)) >= LEAST_LENGTH:
                        total[word] += k
                if len(total) > CACHE_WORDS:
                    yield flushed(total)
                    total.clear()
        yield flushed(total)

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def buckets(words: DataFrame) -> DataFrame:
    """(key, m, a, b, e, word, n): words that may be one edit apart meet in a bucket.

    Of two words one edit apart, the shorter with m letters, the first m // 2 letters are equal, or the last m - m // 2 are.
    Buckets hold words of m and m + 1 letters that share their first ``a`` and last ``b`` letters. One with more than
    BUCKET_WORDS is split the same way by what is not shared. Words that could meet in both parts meet in the first: in the second
    they must not agree up to letter ``e``.
    """
    shared = F.concat_ws(" ", "m", "path", F.expr("left(word, a)"), F.expr("right(word, b)"))
    left = F.col("m") - F.col("a") - F.col("b")

    def halved(rows: DataFrame) -> DataFrame:
        x = F.floor(left / 2).cast("int")
        parts = F.array(F.struct(F.concat("path", F.lit("1")).alias("path"), (F.col("a") + x).alias("a"), F.col("b").alias("b"), F.col("e").alias("e")),
                        F.struct(F.concat("path", F.lit("2")).alias("path"), F.col("a").alias("a"), (F.col("b") + left - x).alias("b"),
                                 F.least("e", F.col("a") + x).alias("e")))
        return rows.select("word", "n", "m", F.explode(parts).alias("p")).select("word", "n", "m", "p.*").withColumn("key", shared)

    size = F.char_length("word")
    start = words.select("word", "n", F.explode(F.array(size - 1, size)).alias("m")).where(F.col("m") >= LEAST_LENGTH)
    rows, done = halved(start.select("*", F.lit("").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1 << 30).alias("e"))), []
    while True:
        rows = materialize(rows, "spelling-buckets")
        large = rows.where(left >= 2).groupBy("key").count().where(F.col("count") > BUCKET_WORDS).select("key")
        large = materialize(large, "spelling-large")
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = halved(rows.join(large, "key", "left_semi"))
    for part in done:
        rows = rows.unionByName(part)
    return rows.select("key", "m", "a", "b", "e", "word", "n")


def near_in_list(regions: list[bytes], shorter: int, differ_by: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places of the regions one edit away) in a sorted list of different regions, of ``shorter`` or one more letters.

    The list is scanned once for all of its words as queries. Row i of the edit matrix, cells i - 1 to i + 1, belongs to the
    first i letters; the rows of the letters that a region shares with the one before stand on a stack and are used again, and queries whose row
    has no cell of at most one edit are left out in all regions that share these letters. Queries that agree with the first ``differ_by``
    letters are left out there. Two regions that both have the further letter are not compared.
    """
    width = shorter + 2
    q = np.zeros((len(regions), width), "u1")
    for i, r in enumerate(regions):
        q[i, :len(r)] = np.frombuffer(r, "u1")
    longer = np.array([len(r) > shorter for r in regions])
    everyone = np.arange(len(regions))
    one = np.ones(len(regions), "i1")
    stack = [(everyone, one * OVER, one * 0, one)]
    before = b""
    for place, region in enumerate(regions):
        same = 0
        while same < len(before) and same < len(region) and before[same] == region[same]:
            same += 1
        del stack[same + 1:]
        before = region
        for i in range(len(stack), len(region) + 1):
            alive, c0, c1, c2 = stack[-1]
            if not len(alive):
                break
            letter, cells = region[i - 1], q[alive]
            n0 = np.minimum(c0 + (cells[:, i - 2] != letter), c1 + 1) if i > 1 else c1 + 1
            n1 = np.minimum(np.minimum(c1 + (cells[:, i - 1] != letter), c2 + 1), n0 + 1)
            n2 = np.minimum(c2 + (cells[:, i] != letter), n1 + 1) if i < width else n1 + 1
            keep = (n0 <= 1) | (n1 <= 1) | (n2 <= 1)
            if i == differ_by:
                keep &= n1 > 0
            stack.append((alive[keep], n0[keep], n1[keep], n2[keep]))
        if len(stack) == len(region) + 1 and len(stack[-1][0]):
            alive, c0, c1, c2 = stack[-1]
            if len(region) > shorter:  # cells of the queries' own lengths
                near = alive[(c0 == 1) & ~longer[alive]]
            else:
                near = alive[np.where(longer[alive], c2, c1) == 1]
            if len(near):
                yield place, near


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n_near, best): per bucket the number of near words, and (-n, word) of the most frequent one, smallest first in ties."""
    def found(bucket: list[dict]) -> pa.RecordBatch | None:
        first = bucket[0]
        a, b, m = first["a"], first["b"], first["m"]
        words, n = [r["word"] for r in bucket], np.array([r["n"] for r in bucket])
        regions = [w[a:len(w) - b].encode("latin-1") for w in words]
        rank = np.empty(len(words), "int64")
        rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
        by_rank = np.argsort(rank)
        near = [(place, len(others), by_rank[rank[others].min()]) for place, others in near_in_list(regions, m - a - b, first["e"] - a)]
        if not near:
            return None
        best = pa.StructArray.from_arrays([pa.array([-int(n[k]) for _, _, k in near], pa.int64()), pa.array([words[k] for _, _, k in near])], ["less", "form"])
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i, _, _ in near]), pa.array([k for _, k, _ in near], pa.int64()), best], ["word", "n_near", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if bucket and bucket[0]["key"] != row["key"]:
                    if len(bucket) > 1 and (out := found(bucket)) is not None:
                        yield out
                    bucket = []
                bucket.append(row)
        if len(bucket) > 1 and (out := found(bucket)) is not None:
            yield out

    region = F.expr("substring(word, a + 1, char_length(word) - a - b)")
    dealt = rows.repartition(groups_for(rows.count(), TASK_ROWS), "key").withColumn("region", region).sortWithinPartitions("key", "region").drop("region")
    each = dealt.mapInArrow(run, "word string, n_near long, best struct<less: long, form: string>")
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last one on the way. A form has RATIO times the count, so ways are short; each round doubles what they cover."""
    here = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = here.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = here.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(moved, "spelling-roots")
        here = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return here


def frequent_form(n: Column, form_n: Column) -> Column:
    return form_n >= RATIO * n


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants in all texts: one row per word of at least LEAST_LENGTH letters and LEAST_COUNT occurrences.

    Columns: word, n, n_near (words one inserted, deleted or replaced letter away), form (the near word of largest n, the smallest in code-point order
    among equals, if that is RATIO times the word's n), form_n, root (what the forms lead to, or the word itself). Words are runs of
    A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, less a letter where the hash of id and run is divisible by TYPOS; a null id is
    hashed as an empty one. Null and empty texts have no words, repeated rows count again, other columns are ignored; without words
    there are no rows. Only words and counts are shuffled. A bucket of words that may be near is at most BUCKET_WORDS, or differs in one letter.
    """
    words = materialize(word_counts(docs, id_col, text_col), "spelling-words")
    near = near_words(buckets(words))
    told = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    has = F.coalesce(frequent_form(F.col("n"), F.col("form_n")), F.lit(False))
    told = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.form")).alias("form"),
                                   F.when(has, F.col("form_n")).alias("form_n")), "spelling-forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
