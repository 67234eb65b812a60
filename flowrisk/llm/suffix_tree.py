"""Operator 8: language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import groups_for, mapped_bytes, split_words, text_slices
from flowrisk.session import materialize, materialize_by, shuffles_dropped

ADD = 0.1            # added to every count at the root
DISCOUNT = 0.5       # taken off every kept count below the root
LEAST = 2.0          # times that words, contexts and entries of the tree occur at least, whatever the input
# Further cuts by share of the training tokens for words, contexts and entries; none.
WORD_SHARE = CONTEXT_SHARE = PAIR_SHARE = 0.0
DEPTH = 3
CACHE_WORDS = 300_000
CHUNK_TEXTS, CHUNK_BYTES = 2_500, 8 << 20  # of a chunk, at most; larger ones ask less often for the same entries, but take more of a task's memory
SHARD_TOKENS = 4_000_000  # tokens for each shard of the tree; a shard's part of a level is one task's
END = 1              # stands for the end of a text; a word's number is a hash of 64 bits
WORDS, CONTEXTS = 0, 1   # kinds of requests: for counts of words or entries, and for contexts
# A chunk is one row of some MB: row groups are closed by their size, not after a hundred rows.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
REQUEST = "shard int, kind int, level int, chunk long, n long, keys binary, counts binary, sizes binary, entries binary, shorter binary"
REPLY = "chunk long, kind int, level int, shard int, n long, value binary, own binary, known long"


def number_of(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of sequences: that of all but the last word, and the last word."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, which compresses well where they are small."""
    raw = np.ascontiguousarray(values.view("u1").reshape(len(values), values.itemsize).T)
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), "u1")
    return np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8", n), dtype="<u8")


def chunks(rows: DataFrame) -> DataFrame:
    """One row per batch of texts: chunk, its ids, held flags and lengths, its distinct words with training counts, and all tokens as places there."""
    kind = rows.schema["__id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers = TaskContext.get().partitionId() << 40, {}
        for batch in text_slices(batches, 2, CHUNK_TEXTS, CHUNK_BYTES):
            if len(numbers) > CACHE_WORDS:
                numbers = {}
            held = batch.column(1).to_pylist()
            words, lengths = split_words(mapped_bytes(batch.column(2), bytes.lower))
            found, lengths = words.dictionary_encode(), lengths + 1
            tokens, inner = np.zeros(len(words) + len(held), "<i4"), np.ones(len(words) + len(held), bool)
            inner[np.cumsum(lengths) - 1] = False
            tokens[inner] = found.indices.to_numpy() + 1   # 0 is the end
            distinct = found.dictionary.cast(pa.binary()).to_pylist()
            for w in distinct:
                if w not in numbers:
                    numbers[w] = number_of(w)
            words = np.array([END, *map(numbers.__getitem__, distinct)], "<i8")
            tf = np.bincount(tokens, np.repeat(~np.array(held, bool), lengths), len(words)).astype("<i8")
            yield pa.RecordBatch.from_arrays([
                pa.array([at]), pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()),
                pa.array([packed(tf)], pa.binary()), pa.array([packed(tokens)], pa.binary()), pa.array([len(tokens)]), pa.array([int(tf.sum())])],
                ["chunk", "ids", "held", "lengths", "words", "tf", "tokens", "n_tokens", "trained"])
            at += 1

    return rows.mapInArrow(run, f"chunk long, ids array<{kind.simpleString()}>, held array<boolean>, lengths array<long>, words binary, tf binary, tokens binary, "
                                "n_tokens long, trained long")


@dataclass
class Tree:
    """What all chunks and shards are to know."""

    gain: float
    shards: int
    below: float = 1.0                          # what root counts are divided by
    least: tuple[float, float, float] = (LEAST,) * 3   # counts of words, contexts and entries


class Chunk:
    """The tokens of a chunk, which go up level by level with what the tree replies.

    Requests are sorted by key and cut by shard, and replies are their values in the same order, so that no key travels back.
    """

    def __init__(self, row: pa.Table, told: pa.Table | None, tree: Tree):
        self.tree, self.chunk = tree, row.column("chunk")[0].as_py()
        self.lengths = row.column("lengths").combine_chunks().flatten().to_numpy()
        self.first = np.cumsum(self.lengths) - self.lengths
        self.held = np.array(row.column("held")[0].as_py(), bool)
        self.keys, to = np.unique(np.frombuffer(row.column("words")[0].as_py(), "<u8"), return_inverse=True)
        self.words, self.at = self.keys, to.astype("<i4")[unpacked(row.column("tokens")[0].as_py(), "<i4", int(self.lengths.sum()))]
        if told is None:
            self.tf = np.bincount(to, unpacked(row.column("tf")[0].as_py(), "<i8", len(to)), len(self.keys))
            return
        self.told = {}
        for r in sorted(told.to_pylist(), key=lambda r: r["shard"]):
            self.told.setdefault((r["kind"], r["level"]), []).append(r)
        self.n, _ = self.reply(WORDS, 0, "<i8")
        count = self.n[self.at]
        self.known, self.root = count > 0, (count + ADD) / tree.below
        self.common = (self.words[self.at] == END) | (count >= tree.least[0])
        self.entry, self.p = np.where(count >= tree.least[1], self.at, np.int32(-1)), self.root

    def reply(self, kind: int, level: int, of: str) -> tuple[np.ndarray, np.ndarray]:
        """The values of all keys that were asked for, and which of them are this chunk's own."""
        rows = self.told.pop((kind, level), [])
        value = [unpacked(r["value"], of, r["n"]) for r in rows]
        own = [np.unpackbits(np.frombuffer(r["own"], "u1"), count=r["n"]) for r in rows]
        return np.concatenate([np.zeros(0, of), *value]), np.concatenate([np.zeros(0, "u1"), *own]).astype(bool)

    def ascend(self) -> None:
        """To the next level: the contexts of all tokens, and their entries."""
        context = np.empty_like(self.entry)
        context[1:], context[self.first] = self.entry[:-1], -1
        self.there = np.flatnonzero(context >= 0)
        used = np.zeros(len(self.keys), bool)
        used[context[self.there]] = True
        self.contexts, self.totals = self.keys[used], self.n[used]
        self.context = np.append(np.cumsum(used) - 1, -1).astype("<i4")[context]
        on = self.there[self.common[self.there]]
        self.keys, entry = np.unique(extended(self.contexts[self.context[on]], self.words[self.at[on]]), return_inverse=True)
        self.on, self.entry_on = on, entry
        self.entry = np.full(len(self.at), -1, "<i4")
        self.entry[on] = entry

    def counted(self, level: int) -> None:
        self.n, self.own = self.reply(WORDS, level, "<i8")
        self.own &= self.n > 0
        self.entry = np.where(np.append(self.n > 0, False)[self.entry], self.entry, np.int32(-1))

    def smoothed(self, level: int) -> None:
        rest, _ = self.reply(CONTEXTS, level, "<f8")
        on = self.there[~np.isnan(rest[self.context[self.there]])]
        c, e = self.context[on], self.entry[on]
        share = np.append(np.maximum(self.n - DISCOUNT, 0), 0.0)[e]
        self.p = self.p.copy()
        self.p[on] = share / self.totals[c] + rest[c] * self.p[on]

    def cut(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(shard, from, to) of the shards that have any of the sorted keys."""
        n = self.tree.shards
        bounds = np.searchsorted(keys, np.array([(s << 64) // n for s in range(1, n)], "<u8"))
        for s, (a, b) in enumerate(zip([0, *bounds.tolist()], [*bounds.tolist(), len(keys)])):
            if b > a:
                yield s, a, b

    def ask_counts(self, level: int) -> list[tuple]:
        return [(s, WORDS, level, self.chunk, b - a, packed_keys(self.keys[a:b]), packed(self.tf[a:b].astype("<i8")), None, None, None) for s, a, b in self.cut(self.keys)]

    def ask_contexts(self, level: int) -> list[tuple]:
        """All contexts, with those of their entries that are this chunk's to tell."""
        own, token = np.flatnonzero(self.own), np.zeros(len(self.keys), "<i4")
        token[self.entry_on] = self.on                     # one that shows the entry
        of = self.context[token[own]]
        own = own[np.argsort(of, kind="stable")]
        sizes = np.bincount(of, minlength=len(self.contexts)).astype("<i8")
        ends, n, shorter = np.concatenate([[0], np.cumsum(sizes)]), self.n[own], self.p[token[own]]
        return [(s, CONTEXTS, level, self.chunk, b - a, packed_keys(self.contexts[a:b]), packed(self.totals[a:b]), packed(sizes[a:b]),
                 packed(n[ends[a]:ends[b]]), packed(shorter[ends[a]:ends[b]])) for s, a, b in self.cut(self.contexts)]

    def requests(self, step: int, depth: int) -> list[tuple]:
        """What the chunk asks in a step: for words, then for the entries of a level with the contexts of the one before, then for the last contexts."""
        if step == 0:
            return self.ask_counts(0)
        out = []
        for level in range(1, step + 1):
            if level > 1:
                self.counted(level - 1)
                if level == step:
                    out += self.ask_contexts(level - 1)
                else:
                    self.smoothed(level - 1)
            if level <= depth:
                self.ascend()
        if step <= depth:
            self.tf = np.bincount(self.entry_on, np.repeat(~self.held, self.lengths)[self.on], len(self.keys))
            out += self.ask_counts(step)
        return out


def rows_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def answered(asked: pa.Table, tree: Tree) -> pa.Table:
    """The replies to all requests of one kind for one shard."""
    rows = asked.to_pylist()
    keys, to = np.unique(np.concatenate([unpacked_keys(r["keys"], r["n"]) for r in rows]), return_inverse=True)
    counts = np.concatenate([unpacked(r["counts"], "<i8", r["n"]) for r in rows])
    if rows[0]["kind"] == WORDS:
        n = np.bincount(to, counts, len(keys)).astype("<i8")
        known = int((n > 0).sum())
        if rows[0]["level"]:
            n[n < tree.least[2]] = 0
        first = np.zeros(len(keys), "int64")
        first[to[::-1]] = np.arange(len(to))[::-1]
        own, value = np.zeros(len(to), bool), n[to]
        own[first] = True
    else:
        known, own, value = 0, np.zeros(len(to), bool), kept_contexts(rows, keys, to, counts, tree.gain)[to]
    ends, out = np.cumsum([r["n"] for r in rows]), []
    for r, b in zip(rows, ends.tolist()):
        part = slice(b - r["n"], b)
        out.append((r["chunk"], r["kind"], r["level"], r["shard"], r["n"], packed(value[part]), np.packbits(own[part]).tobytes(), known))
        known = 0
    return rows_of(out, REPLY)


def kept_contexts(rows: list[dict], keys: np.ndarray, to: np.ndarray, totals: np.ndarray, gain: float) -> np.ndarray:
    """The share left to the shorter context, of contexts whose next words differ from the shorter one's; else NaN.

    The test is a log-likelihood ratio over the entries: it has to reach ``gain`` nats for each of them. Words without an entry get a smaller
    share than before.
    """
    total = np.zeros(len(keys))
    total[to] = totals
    sizes = [unpacked(r["sizes"], "<i8", r["n"]) for r in rows]
    of = np.repeat(to, np.concatenate(sizes))
    n = np.concatenate([unpacked(r["entries"], "<i8", int(x.sum())) for r, x in zip(rows, sizes)])
    shorter = np.concatenate([unpacked(r["shorter"], "<f8", int(x.sum())) for r, x in zip(rows, sizes)])
    types, left = np.bincount(of, minlength=len(keys)), total - np.bincount(of, n, len(keys))
    rest = 1 - np.bincount(of, n - DISCOUNT, len(keys)) / total
    longer = (n - DISCOUNT) / total[of] + rest[of] * shorter
    gained = np.bincount(of, n * np.log(longer / shorter), len(keys)).astype("f8")  # of no entries it counts whole numbers
    some = left > 0
    gained[some] += left[some] * np.log(rest[some])
    return np.where((types > 0) & (gained >= gain * types), rest, np.nan)


def text_scores(row: pa.Table, told: pa.Table, tree: Tree, depth: int) -> pa.Table:
    """Per text: tokens, known tokens, and log10 sums at the root and in the tree."""
    chunk = Chunk(row, told, tree)
    for level in range(1, depth + 1):
        chunk.ascend()
        chunk.counted(level)
        chunk.smoothed(level)
    add = lambda x: np.add.reduceat(x, chunk.first)
    return pa.table({"__id": row.column("ids").combine_chunks().flatten(), "held": chunk.held, "n_tokens": chunk.lengths,
                     "n_known": add(chunk.known.astype("int64")), "base": add(np.log10(chunk.root)), "score": add(np.log10(chunk.p))})


def held_out(id_: Column) -> Column:
    """Whether a row is kept out of the training: by its id; rows without an id are trained on."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score(docs: DataFrame, depth: int = DEPTH, gain: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probability of every text under a probabilistic suffix tree: one row per input row.

    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score (root alone: unigrams with ADD), score.
    Tokens are words with A-Z in lower case, then one end; null and blank texts are an end alone. Texts whose
    id is held out are scored and not learned from. A context of up to ``depth`` words is in the tree
    if it occurs LEAST times, as its entries do, and its next words differ from those after its shorter suffix by a likelihood-ratio
    test; the longest one before a word gives its distribution, smoothed with the shorter ones down to the root.

    The tree is tables that grow with the corpus, keyed by hashes of 64 bits and dealt out over shards by key. A chunk of texts asks for each of its
    distinct words and entries once, level by level; a shard replies with what occurs often enough, in the order it was asked. An entry is asked for only if its
    context may be in the tree, and one of the chunks that have it tells the shard of its context. Requests and replies are packed, sorted
    columns, one row per chunk and shard; tasks hold one chunk with its replies, or what is asked of one shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("__text"))
    with shuffles_dropped(spark):
        coded = materialize_by(chunks(rows), "suffix-chunks", "chunk", **SMALL_GROUPS)
    tokens, total = coded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    tree = Tree(gain, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups_for(tokens, SHARD_TOKENS)),
                least=tuple(max(LEAST, share * total) for share in (WORD_SHARE, CONTEXT_SHARE, PAIR_SHARE)))

    def by_chunk(run: Callable, schema: str, *columns: str) -> DataFrame:
        left = coded.select("chunk", "held", "lengths", "words", "tokens", *columns).groupBy("chunk")
        if not replies:
            return left.applyInArrow(lambda row: run(row, None), schema)
        return left.cogroup(reduce(DataFrame.unionByName, replies).groupBy("chunk")).applyInArrow(run, schema)

    def exchanged(step: int, tree: Tree) -> DataFrame:
        asked = by_chunk(lambda row, told: rows_of(Chunk(row, told, tree).requests(step, depth), REQUEST), REQUEST, *([] if step else ["tf"]))
        told = asked.groupBy("kind", "shard").applyInArrow(lambda part: answered(part, tree), REPLY)
        with shuffles_dropped(spark):
            return materialize(told, f"suffix-replies-{step}")

    replies = []
    for step in range(depth + 2):
        replies.append(exchanged(step, tree))
        if not step:
            known = replies[0].agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
            tree = replace(tree, below=total + ADD * (known + 1))

    kind = rows.schema["__id"].dataType.simpleString()
    out = by_chunk(lambda row, told: text_scores(row, told, tree, depth), f"__id {kind}, held boolean, n_tokens long, n_known long, base double, score double", "ids")
    return out.select(F.col("__id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      F.col("base").alias("base_score"), "score")
