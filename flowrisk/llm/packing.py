"""Operator 2: packing documents into fixed-length training sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import groups_for, mapped_bytes, split_words, text_slices
from flowrisk.llm.token_counts import byte_alphabet

END_ID = 2
CACHE_WORDS = 400_000
SLICE_DOCS = 512
GROUP_DOCS = 8_192
# Lower-case Latin letters, composed, then plain marks: two pre-tokens that no normaliser changes. Or any other word.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,!?;:]*)(?= |$)|([^ ]+)")


class Table:
    """Runs of 32-bit numbers, one behind the other in an array that grows."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size = np.zeros(1 << 12, "int64"), np.zeros(1 << 12, "int64")
        self.n = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        """Append runs; the number of the first of them."""
        first, n, used = self.n, self.n + len(sizes), self.used + len(flat)
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(used + len(self.flat), "<u4")])
        if n > len(self.size):
            more = np.zeros(n + len(self.size), "int64")
            self.start, self.size = np.concatenate([self.start[:first], more]), np.concatenate([self.size[:first], more])
        self.flat[self.used:used] = flat
        self.start[first:n], self.size[first:n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.n, self.used = n, used
        return first

    def of(self, runs: np.ndarray) -> np.ndarray:
        """The numbers of many runs, one run behind the other."""
        sizes = self.size[runs]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.start[runs] - (ends - sizes), sizes)
        return self.flat[shift + np.arange(len(shift))]


class Encoder:
    """Token ids of words; words that were seen are looked up.

    A pre-token never spans white space, so the ids of a text are those of its words. Plain words go to the
    tokenizer's own model many at a time, without normaliser and pre-tokenizer, which leave them as they are;
    a piece with a word end closes each. The marks behind them are pieces of their own. All other words are encoded in full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.full.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.forget()

    def forget(self) -> None:
        self.table = Table()                   # ids of cores, marks and whole words; run 0 is empty
        self.table.add(np.zeros(0, "<u4"), np.zeros(1, "int64"))
        self.cores: dict[str, int] = {}
        self.marks: dict[str, int] = {"": 0}
        self.place: dict[bytes, int] = {}      # words, and the runs of their two parts
        self.parts = np.zeros((1 << 12, 2), "int64")

    def __getitem__(self, word: bytes) -> bytes:
        return self.ids(np.array([self.place[word]])).tobytes()

    @property
    def seen(self) -> Encoder:
        """Ids as bytes, by word."""
        return self

    def ids(self, places: np.ndarray) -> np.ndarray:
        return self.table.of(self.parts[places].ravel())

    def sizes(self, places: np.ndarray) -> np.ndarray:
        return self.table.size[self.parts[places]].sum(axis=1)

    def _whole(self, words: list[str]) -> dict[str, int]:
        ids = [np.array(e.ids, "<u4") for e in self.full.encode_batch_fast(words, add_special_tokens=False)]
        first = self.table.add(np.concatenate([np.zeros(0, "<u4"), *ids]), np.array([len(x) for x in ids], "int64"))
        return dict(zip(words, range(first, first + len(words))))

    def _plain(self, words: list[str]) -> dict[str, int]:
        if not words:
            return {}
        text = " ".join(words).encode().decode("latin-1").translate(self.shown | {32: " "})
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        first = self.table.add(ids, np.diff(np.flatnonzero(self.closes[ids]) + 1, prepend=0))
        return dict(zip(words, range(first, first + len(words))))

    def learn(self, words: Iterable[bytes]) -> None:
        new = [w for w in words if w not in self.place]
        parts = PLAIN.findall(b" ".join(new).decode())
        self.cores |= self._plain([c for c in dict.fromkeys(core for core, _, _ in parts) if c and c not in self.cores])
        self.marks |= self._whole([m for m in {m for _, m, _ in parts} if m not in self.marks])
        whole = self._whole([w for _, _, w in parts if w])
        first = len(self.place)
        self.place |= zip(new, range(first, first + len(new)))
        if len(self.place) > len(self.parts):
            self.parts = np.concatenate([self.parts[:first], np.zeros((len(self.place) + first, 2), "int64")])
        self.parts[first:first + len(new)] = np.array([(self.cores[core], self.marks[m]) if core else (whole[w], 0) for core, m, w in parts], "int64").reshape(-1, 2)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words, of which new ones are learned."""
        if len(self.place) > CACHE_WORDS:
            self.forget()
        self.learn(words)
        return np.fromiter(map(self.place.__getitem__, words), "int64", len(words))


def words_of_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of a column of texts, and for every text the places of its words there, as one array with the number of words of each text.

    Special tokens are found with their case, in all other texts A-Z are lower-cased, as the tokenizer does.
    """
    lower = mapped_bytes(texts, bytes.lower)
    words, lengths = split_words(pc.if_else(pc.match_substring(lower, "<|"), texts, lower))
    return words.dictionary_encode(), lengths


class FirstFit:
    """First-fit bins, found with a tournament tree over their free space.

    Leaves are bins in the order of opening and inner nodes hold the larger free space of their
    children, so the first bin with room is found on one way down from the root.
    """

    def __init__(self, capacity: int, most_bins: int):
        self.leaves = 1 << max(0, most_bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def put(self, length: int) -> tuple[int, int]:
        """(bin, place in it) for a piece of at most the capacity."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        start = self.capacity - tree[node]
        tree[node] -= length
        found = node - self.leaves
        while node > 1:
            node >>= 1
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return found, start


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Tokenise every text, append END_ID, and cut it into pieces of at most ``capacity`` ids.

    One row per piece: id, start, length, ids_crc32, doc_tokens, salt. A null text is an empty one
    and yields the single END_ID. A task remembers the ids of about CACHE_WORDS words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, at = Encoder(tokenizer_path), np.array([END_ID], "<u4").tobytes(), 0
        for batch in text_slices(batches, 1, SLICE_DOCS):
            words, lengths = words_of_texts(batch.column(1))
            places = encoder.places(words.dictionary.cast(pa.binary()).to_pylist())[words.indices.to_numpy()]
            ids = memoryview(encoder.ids(places).tobytes())
            sizes = np.concatenate([[0], np.cumsum(encoder.sizes(places))])
            bounds = sizes[np.concatenate([[0], np.cumsum(lengths)])].tolist()
            order, start, length, crc, total = [], [], [], [], []
            for n, (first, last) in enumerate(zip(bounds, bounds[1:])):
                size = last - first + 1
                for s in range(0, size, capacity):
                    stop = min(s + capacity, size)
                    part = zlib.crc32(ids[4 * (first + s):4 * min(first + stop, last)])
                    order.append(n)
                    start.append(s)
                    length.append(stop - s)
                    crc.append(zlib.crc32(end, part) if stop == size else part)
                    total.append(size)
            salt = np.arange(at, at + len(order), dtype="int64")
            at += len(order)
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total, salt)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order, pa.int64())), *numbers],
                                             ["__id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def pack(pieces: DataFrame, groups: int, capacity: int = 4096) -> DataFrame:
    """First-fit decreasing inside randomised groups of pieces: adds sequence_id and offset.

    ``pieces`` needs __id, start, length and salt. A group is drawn from the hash of the row, so
    that it is a fair mix of lengths and as large as any other, whichever document or source is
    frequent; repeated rows differ in ``salt``. Ties in length are broken by (id, start, salt).
    """
    def run(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, [("length", "descending"), ("__id", "ascending"), ("start", "ascending"),
                                                ("salt", "ascending")]))
        group, bins = part.column("__group")[0].as_py(), FirstFit(capacity, part.num_rows)
        placed = np.array([bins.put(n) for n in part.column("length").to_pylist()], "int64").reshape(-1, 2)
        return (part.drop_columns(["__group", "salt"]).append_column("sequence_id", pa.array((group << 32) + placed[:, 0]))
                .append_column("offset", pa.array(placed[:, 1])))

    kept = [f for f in pieces.schema.fields if f.name != "salt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return (pieces.withColumn("__group", F.pmod(F.xxhash64("__id", "start", "salt"), F.lit(groups)))
            .groupBy("__group").applyInArrow(run, schema))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, group_docs: int = GROUP_DOCS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens: one row per piece.

    A long document fills whole sequences of its own; what is left of it is packed with other
    documents by first-fit decreasing, in random groups of about ``group_docs`` documents. Columns:
    id, start, length, ids_crc32 (of the little-endian 32-bit ids), doc_tokens, sequence_id, offset.
    Within a sequence the offsets are gapless from 0. Null and empty texts are one END_ID. Only
    five numbers per piece are shuffled, never texts or ids.
    """
    groups = groups_for(docs.count(), group_docs)
    pieces = token_pieces(docs, tokenizer_path, capacity, id_col, text_col)
    return pack(pieces, groups, capacity).withColumnRenamed("__id", id_col)


def sequences(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """Tokens and padded length of each sequence: padded to ``capacity``, except at a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces"))
    is_power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return used.withColumn("padded", F.when(is_power, F.col("tokens")).otherwise(F.lit(capacity).cast("long")))


def write_sequences(packed: DataFrame, path: str) -> None:
    """Write the pieces with each sequence in one file, in order."""
    packed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").write.mode("overwrite").parquet(path)


