"""Operator 12: benchmark passages in training documents, looked up in an FM-index of every shard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.llm.common import groups_for, lower_ascii, mapped_bytes, split_words, text_slices
from flowrisk.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # digits, ASCII letters (in lower case before) and all beyond ASCII
WINDOW = 10
PLACE_BITS = 19                 # a shard has less than 2 ** PLACE_BITS words and ends
SHARD_WORDS = (1 << PLACE_BITS) - 1
PIECE_WORDS = 1 << 16           # longer documents are cut into pieces that overlap by a window less one word
SLICE_DOCS = 512
SAMPLE = 8                      # every such position of a shard is kept to locate occurrences
BLOCK_WINDOWS = 20_000          # windows that are looked up together
LOCATED = 1 << 18               # occurrences that are located together
# What each byte of UTF-8 becomes: words keep their length, all else is a blank.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, and how many each text has; null has none."""
    return split_words(mapped_bytes(texts, lambda raw: raw.translate(PLAIN)))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``, whose last symbol occurs once, by prefix doubling.

    Suffixes that are already told apart drop out; (rank, rank further on, position) is sorted as one number.
    """
    n, mask = len(text), (1 << PLACE_BITS) - 1
    slots, at, step = np.arange(n), np.arange(n), 1
    rank, order = text.astype("int64"), np.empty(n, "int64")
    while len(at):
        ahead = at + step
        ahead[ahead >= n] -= n
        key = np.sort((rank[at] << (2 * PLACE_BITS + 1)) | (rank[ahead] << PLACE_BITS) | at)
        at = key & mask
        key >>= PLACE_BITS
        order[slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        same = ~(new & np.concatenate([new[1:], [True]]))
        slots, at, step = slots[same], at[same], 2 * step
    return order


def packed(flags: np.ndarray) -> np.ndarray:
    """Bits in words of 64, with a word to spare."""
    out = np.zeros(len(flags) // 64 + 1, "<u8")
    raw = np.packbits(flags, bitorder="little")
    out.view("u1")[:len(raw)] = raw
    return out


def fm_index(words: pa.Array, lengths: np.ndarray) -> dict:
    """Index of the pieces' words: distinct words, their counts, wavelet-tree bits level by level, sampled rows and positions.

    Every piece is followed by an end of its own; ends are the symbols before the words.
    """
    coded = words.dictionary_encode()
    ends = np.cumsum(lengths + 1) - 1
    text = np.empty(len(words) + len(lengths), "int32")
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[ends] = np.arange(len(ends))
    text[inside] = coded.indices.to_numpy() + len(ends)
    order = suffix_array(text)
    symbols, levels = text[order - 1], (len(ends) + len(coded.dictionary) - 1).bit_length()
    bits = []
    for level in reversed(range(levels)):  # a level's ones go behind its zeros in the next one
        one = (symbols >> level & 1).astype(bool)
        bits.append(packed(one))
        symbols = np.concatenate([symbols[~one], symbols[one]])
    kept = order % SAMPLE == 0
    return {"vocab": coded.dictionary, "counts": np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype("<i4").tobytes(),
            "n": len(text), "bits": b"".join(b.tobytes() for b in bits), "marks": packed(kept).tobytes(), "places": order[kept].astype("<i4").tobytes()}


class Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype="int64")])

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype("uint64")) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype("uint64") & np.uint64(1)).astype(bool)


class Searcher:
    """Backward search and location in the index of a shard."""

    def __init__(self, vocab: pa.Array, counts: bytes, n: int, pieces: int, bits: bytes, marks: bytes, places: bytes):
        self.vocab, self.pieces = vocab, pieces
        sizes = np.concatenate([np.ones(pieces, "int64"), np.frombuffer(counts, "<i4")])
        self.levels = (len(sizes) - 1).bit_length()
        per = n // 64 + 1
        raw = np.frombuffer(bits, "<u8")
        self.tree = [Bits(raw[i * per:(i + 1) * per]) for i in range(self.levels)]
        self.zeros = [n - int(b.before[-1]) for b in self.tree]
        self.marks, self.places = Bits(np.frombuffer(marks, "<u8")), np.frombuffer(places, "<i4")
        self.first = np.cumsum(sizes) - sizes
        self.sizes = sizes
        # Below the last level symbols stand in the order of their reversed bits.
        symbol, turned = np.arange(len(sizes)), np.zeros(len(sizes), "int64")
        for i in range(self.levels):
            turned |= (symbol >> i & 1) << (self.levels - 1 - i)
        order = np.argsort(turned)
        start = np.empty_like(self.first)
        start[order] = np.cumsum(sizes[order]) - sizes[order]
        self.shift = self.first - start

    def step(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where the rows before ``rows`` that ``symbols`` precede begin in the suffix order."""
        for level, bits in enumerate(self.tree):
            ones = bits.ones(rows)
            rows = np.where(symbols >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, rows - ones)
        return rows + self.shift[symbols]

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer."""
        symbols = np.zeros(len(rows), "int64")
        for level, bits in enumerate(self.tree):
            one, ones = bits.get(rows), bits.ones(rows)
            symbols = 2 * symbols + one
            rows = np.where(one, self.zeros[level] + ones, rows - ones)
        return rows + self.shift[symbols]

    def symbols_of(self, words: pa.Array) -> np.ndarray:
        """Symbols of distinct words; -1 for those the shard doesn't have."""
        found = pc.index_in(self.vocab, value_set=words)
        there = found.is_valid().to_numpy(zero_copy_only=False)
        out = np.full(len(words), -1, "int64")
        out[found.drop_null().to_numpy()] = np.flatnonzero(there) + self.pieces
        return out

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of the phrases that occur.

        A row of ``phrases`` holds the symbols of one, last word first: -1 for an unknown word, -2 past its first word.
        """
        alive = np.flatnonzero((phrases != -1).all(axis=1))
        lo = self.first[phrases[alive, 0]]
        hi = lo + self.sizes[phrases[alive, 0]]
        for k in range(1, phrases.shape[1]):
            going = np.flatnonzero(phrases[alive, k] >= 0)
            symbols = phrases[alive[going], k]
            lo[going], hi[going] = self.step(lo[going], symbols), self.step(hi[going], symbols)
            there = hi > lo
            alive, lo, hi = alive[there], lo[there], hi[there]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled one."""
        out, left, steps = np.empty(len(rows), "int64"), np.arange(len(rows)), 0
        while len(left):
            known = self.marks.get(rows)
            out[left[known]] = self.places[self.marks.ones(rows[known])] + steps
            left, rows, steps = left[~known], self.back(rows[~known]), steps + 1
        return out


def index_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One FM-index per shard of about half a million words, in the order the texts are read.

    A document of more than PIECE_WORDS words is several pieces, which overlap so that every ``window`` words stand in one of them.
    Columns: rids (a number per input row), ids, starts (place of the piece in its document), sizes, totals (words of the document), and the
    index. A task holds one shard.
    """
    kind = docs.schema[id_col].dataType

    def close(parts: list, id_type: pa.DataType) -> pa.RecordBatch:
        rids, ids, starts, sizes, totals, words = (list(x) for x in zip(*parts))
        index = fm_index(pa.concat_arrays(words), np.array(sizes, "int64"))
        columns = {"rids": pa.array([rids], pa.list_(pa.int64())), "ids": pa.array([ids], pa.list_(id_type)),
                   **{k: pa.array([v], pa.list_(pa.int64())) for k, v in (("starts", starts), ("sizes", sizes), ("totals", totals))},
                   "vocab": pa.ListArray.from_arrays(pa.array([0, len(index["vocab"])], pa.int32()), index["vocab"]), "n": pa.array([index["n"]], pa.int64()),
                   **{k: pa.array([index[k]], pa.binary()) for k in ("counts", "bits", "marks", "places")}}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, parts, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in text_slices(batches, 1, SLICE_DOCS):
            words, lengths = words_in(batch.column(1))
            at = 0
            for id_, length in zip(batch.column(0).to_pylist(), lengths.tolist()):
                for start in range(0, max(1, length - window + 1), PIECE_WORDS - window + 1):
                    size = min(PIECE_WORDS, length - start)
                    if held + size + 1 > SHARD_WORDS:
                        yield close(parts, batch.column(0).type)
                        parts, held = [], 0
                    parts.append((rid, id_, start, size, length, words.slice(at + start, size)))
                    held += size + 1
                at, rid = at + length, rid + 1
        if parts:
            yield close(parts, batch.column(0).type)

    schema = (f"rids array<long>, ids array<{kind.simpleString()}>, starts array<long>, sizes array<long>, totals array<long>, vocab array<string>, n long, "
              "counts binary, bits binary, marks binary, places binary")
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, items) of the distinct windows: ``window`` consecutive words, or all of an item with fewer, and the ids of the items that have it."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    own = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("__item"), words.alias("__words")).where(F.size("__words") > 0)
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__words") - (window - 1))), lambda i: F.slice("__words", i, window))
    return own.select("__item", F.explode(every).alias("words")).groupBy("words").agg(F.collect_set("__item").alias("items"))


def search(index: DataFrame, phrases: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, starts, ends, items): per document piece and block of phrases the merged spans of words inside occurrences, and the items they are of.

    Phrases (``windows``) are the stated query set; they meet every shard in blocks of about BLOCK_WINDOWS.
    """
    phrases = materialize(phrases, "benchmark-windows")
    n = groups_for(phrases.count(), BLOCK_WINDOWS)
    blocks = phrases.groupBy(F.pmod(F.xxhash64("words"), F.lit(n)).alias("block")).agg(F.collect_list("words").alias("words"), F.collect_list("items").alias("items"))
    # A task for each pair of an index partition and a block, and no more.
    blocks = materialize(blocks.coalesce(n), "benchmark-blocks")

    def look(row: dict) -> pa.RecordBatch:
        phrase_words, items = row["words"].values, row["items"].values
        lengths = pc.list_value_length(phrase_words).to_numpy()
        coded = phrase_words.flatten().dictionary_encode()
        index = Searcher(row["vocab"].values, row["counts"].as_py(), row["n"].as_py(), len(row["rids"]), *(row[k].as_py() for k in ("bits", "marks", "places")))
        symbols = index.symbols_of(coded.dictionary)[coded.indices.to_numpy()]
        last = np.cumsum(lengths) - 1
        matrix = np.full((len(lengths), window), -2, "int64")
        for k in range(window):
            has = lengths > k
            matrix[has, k] = symbols[last[has] - k]
        phrase, lo, hi = index.ranges(matrix)
        starts = np.cumsum(row["sizes"].values.to_numpy() + 1) - row["sizes"].values.to_numpy() - 1
        item_at = np.concatenate([[0], np.cumsum(pc.list_value_length(items).to_numpy())])
        names = items.flatten().dictionary_encode()
        name_of = names.indices.to_numpy()
        begins, ends, of_piece = [], [], []
        done = np.concatenate([[0], np.cumsum(hi - lo)])
        for part in range(0, int(done[-1]), LOCATED):
            occurrence = np.arange(part, min(part + LOCATED, int(done[-1])))
            which = np.searchsorted(done, occurrence, "right") - 1
            place = index.locate(lo[which] + occurrence - done[which])
            piece = np.searchsorted(starts, place, "right") - 1
            begins.append(place)
            ends.append(place + lengths[phrase[which]])
            pairs = np.unique(piece * len(lengths) + phrase[which])
            many, own = np.divmod(pairs, len(lengths))
            size = item_at[own + 1] - item_at[own]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            of_piece.append(np.unique(np.repeat(many, size) * len(names.dictionary) + name_of[np.repeat(item_at[own], size) + inside]))
        if not begins:
            return None
        begin, end = np.concatenate(begins), np.concatenate(ends)
        by = np.argsort(begin, kind="stable")
        begin, end = begin[by], np.maximum.accumulate(end[by])
        new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
        begin, end = begin[new], end[np.concatenate([new[1:], [len(end)]]) - 1]
        piece = np.searchsorted(starts, begin, "right") - 1
        hit, first, n_spans = np.unique(piece, return_index=True, return_counts=True)
        to_document = np.repeat(row["starts"].values.to_numpy()[hit] - starts[hit], n_spans)
        found, name = np.divmod(np.unique(np.concatenate(of_piece)), len(names.dictionary))
        spans = pa.array(np.concatenate([first, [len(begin)]]), pa.int32())
        named = pa.array(np.concatenate([np.searchsorted(found, hit), [len(found)]]), pa.int32())
        return pa.RecordBatch.from_arrays([row["rids"].values.take(pa.array(hit)), pa.ListArray.from_arrays(spans, pa.array(begin + to_document)),
                                           pa.ListArray.from_arrays(spans, pa.array(end + to_document)),
                                           pa.ListArray.from_arrays(named, names.dictionary.take(pa.array(name)))], ["rid", "starts", "ends", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if (out := look({name: batch.column(name)[i] for name in batch.schema.names})) is not None:
                    yield out

    joined = index.select("rids", "starts", "sizes", "vocab", "n", "counts", "bits", "marks", "places").crossJoin(blocks.drop("block"))
    return joined.mapInArrow(run, "rid long, starts array<long>, ends array<long>, items array<string>")


def merged(found: DataFrame) -> DataFrame:
    """(rid, spans, items, n_hit) per document: spans of all its pieces and blocks, joined where they overlap or touch."""
    spans = found.select("rid", F.explode(F.arrays_zip("starts", "ends")).alias("s")).select("rid", F.col("s.starts").alias("a"), F.col("s.ends").alias("b"))
    order = Window.partitionBy("rid").orderBy("a", "b")
    fresh = F.col("a") > F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    whole = (spans.withColumn("fresh", fresh.cast("long")).withColumn("k", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("rid", "k").agg(F.min("a").alias("start"), F.max("b").alias("end"))
             .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit")))
    items = found.select("rid", F.explode("items").alias("i")).groupBy("rid").agg(F.array_sort(F.collect_set("i")).alias("items"))
    return whole.join(items, "rid")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """What of every document occurs in a benchmark: one row per input row.

    Columns: id, n_words, n_hit (words inside an occurrence of a window), items (sorted ids of items with occurring windows, as strings),
    spans (start and end of the hit words, from 0, merged). Words are WORD runs of the whole text with A-Z in
    lower case; a window is ``window`` consecutive words of an item, or all of an item with fewer. Null, empty and wordless texts have
    no words and no hits; items without words are in no document, and items without an id are not looked for. Repeated
    rows are answered one by one; other columns are ignored. Documents are not shuffled: shards are indexed where they are read, the index is
    written once, and only spans and ids travel. A window's list of items is one row.
    """
    index = materialize(index_shards(docs, id_col, text_col, window), "fm-index")
    hits = merged(materialize(search(index, windows(items, item_col, item_text_col, window), window), "benchmark-hits"))
    each = index.select(F.explode(F.arrays_zip("rids", "ids", "starts", "totals")).alias("d")).where("d.starts = 0")
    out = each.select(F.col("d.rids").alias("rid"), F.col("d.ids").alias("__id"), F.col("d.totals").alias("n_words")).join(hits, "rid", "left")
    return out.select(F.col("__id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words, and what stands between those of a span, cut out of their texts.

    Ids must be unique; rows without an id, or without a hit, stay as they are.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column("__spans").to_pylist()):
                if spans:
                    raw = text.encode()
                    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(PLAIN))]
                    for span in reversed(spans):
                        raw = raw[:at[span["start"]][0]] + raw[at[span["end"] - 1][1]:]
                    text = raw.decode()
                out.append(text)
            columns = [pa.array(out, batch.column(c).type) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    hits = found.where("n_hit > 0").select(F.col(id_col).alias("__hit"), F.col("spans").alias("__spans"))
    return docs.join(hits, docs[id_col] == F.col("__hit"), "left").drop("__hit").mapInArrow(cut, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query: number and hash of the items instead of their list."""
    return found.select(found.columns[0], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")
