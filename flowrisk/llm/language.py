"""Operator 4: language of every word and text by a linear-chain conditional random field."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.llm.common import text_slices

TEXTS_PER_LANGUAGE = 250
WORDS_PER_TEXT = 200  # of a training text, from a drawn place
LEXICON = 400         # words per language
EPOCHS = 40
CHUNK = 300_000       # words whose lattice a task holds at once
CACHE_WORDS = 150_000
SLICE = 500           # texts whose words a task holds as bytes at once
LONG, PIECE = 40, 20  # characters of a word that is split, and of its pieces


MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
NO_LETTER = "\0"       # stands for all words without a letter


def stripped(word: bytes) -> str:
    """The word in lower case without marks and digits at its ends; NO_LETTER if nothing is a letter."""
    text = word.decode().lower().strip(MARKS)
    return text if text.isalpha() or any(map(str.isalpha, text)) else NO_LETTER


def words_of(text: str | None) -> list[bytes]:
    """The words of a text. One of LONG or more characters, as in text without spaces, is split into pieces that share
    two characters with the next, so that every trigram counts."""
    words = (text or "").encode().split()
    if max(map(len, words), default=0) < LONG:
        return words
    out = []
    for word in words:
        shown = stripped(word) if len(word) >= LONG else ""
        if len(shown) < LONG:
            out.append(word)
        else:
            out += [shown[i:i + PIECE + 2].encode() for i in range(0, len(shown) - 2, PIECE)]
    return out


def features(text: str) -> set[str]:
    """Affixes and trigrams of a stripped word, and the word itself for the lexicons."""
    if text == NO_LETTER:
        return {text}
    marked = f"<{text}>"
    found = {marked[i:i + 3] for i in range(len(marked) - 2)}
    found.update((marked[:2], marked[-2:], marked[:4], marked[-4:], marked[-5:], "=" + text))
    return found


def lexicons(texts: list[list[bytes]], labels: list[int], n_labels: int, size: int = LEXICON) -> dict[str, int]:
    """The ``size`` most frequent words of each label that hardly occur under another."""
    of = [Counter() for _ in range(n_labels)]
    for words, label in zip(texts, labels):
        of[label].update(map(stripped, words))
    every, out = sum(of, Counter()), {}
    for label, counts in enumerate(of):
        own = [(w, n) for w, n in counts.items() if w != NO_LETTER and n >= 3 and n >= 0.9 * every[w]]
        out.update((w, label) for w, _ in sorted(own, key=lambda x: (-x[1], x[0]))[:size])
    return out


def lattice(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, lengths: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all sequences at once: word marginals, expected transitions (if wanted), log normaliser.

    ``emission`` holds the sequences one after the other, longest first; step t works on all that are longer.
    """
    first = np.cumsum(lengths) - lengths
    potential = emission - emission.max(axis=1, keepdims=True)
    log_z = float((emission.max(axis=1)).sum())
    e, move = np.exp(potential), np.exp(transition)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    steps = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # sequences longer than t
    for t in range(steps):
        at = first[:live[t]] + t
        a = e[at] * (np.exp(start) if t == 0 else alpha[at - 1] @ move)
        z = a.sum(axis=1, keepdims=True)
        alpha[at] = a / z
        log_z += float(np.log(z).sum())
    expected = np.zeros_like(move)
    for t in range(steps - 1, 0, -1):
        at = first[:live[t]] + t
        b = e[at] * beta[at]
        if moves:
            here = alpha[at - 1][:, :, None] * move * b[:, None, :]
            expected += (here / here.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = b @ move.T
        beta[at - 1] = back / back.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True), expected, log_z


@dataclass
class Model:
    """Weights of the features that the training texts show; a word of a lexicon has the feature of its language."""

    labels: list
    rows: dict[str, int]     # row of each feature
    weights: np.ndarray      # (features, labels)
    transition: np.ndarray
    start: np.ndarray


class Emissions:
    """Label weights of words, and whether they have a letter; words that were seen are looked up."""

    def __init__(self, model: Model):
        self.model, self.index, self.by_text = model, {}, {}
        self.rows = np.zeros((0, len(model.labels) + 1))

    def indexes(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The rows of the words of each text."""
        new = list(set().union(*texts).difference(self.index)) if texts else []
        shown = [stripped(w) for w in new]
        unknown = [t for t in dict.fromkeys(shown) if t not in self.by_text]
        if unknown:
            row_of = self.model.rows.get
            found = [[r for r in map(row_of, features(t)) if r is not None] for t in unknown]
            sizes = np.fromiter(map(len, found), "int64", len(found))
            block = np.zeros((len(found), len(self.model.labels) + 1))
            some = np.flatnonzero(sizes)
            if len(some):
                flat = np.fromiter(chain.from_iterable(found), "int64", int(sizes.sum()))
                block[some, :-1] = np.add.reduceat(self.model.weights[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
            block[:, -1] = [t != NO_LETTER for t in unknown]
            self.by_text.update(zip(unknown, range(len(self.rows), len(self.rows) + len(unknown))))
            self.rows = np.concatenate([self.rows, block])
        self.index.update((w, self.by_text[t]) for w, t in zip(new, shown))
        return [np.fromiter(map(self.index.__getitem__, words), "int32", len(words)) for words in texts]


def train(texts: list[tuple[list[bytes], list[int]]], n_labels: int, lexicon: dict[str, int], epochs: int = EPOCHS,
          rate: float = 0.3, decay: float = 1e-4) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, weights, transitions and start weights that fit labelled word sequences, by AdaGrad on the likelihood."""
    texts = sorted((t for t in texts if t[0]), key=lambda t: -len(t[0]))
    lengths = np.array([len(w) for w, _ in texts], "int64")
    index: dict[str, int] = {}
    word_at = np.array([index.setdefault(stripped(w), len(index)) for ws, _ in texts for w in ws], "int64")
    gold = np.array([y for _, ys in texts for y in ys], "int64")
    rows: dict[str, int] = {}
    # The whole word counts only through the lexicon that holds it.
    named = lambda x: f"={lexicon[x[1:]]}" if x[1:] in lexicon else None
    each = [[rows.setdefault(name, len(rows)) for x in sorted(features(t)) if (name := named(x) if x[0] == "=" and len(x) > 1 else x)]
            for t in index]
    flat, sizes = np.concatenate(each), np.array([len(x) for x in each])
    of_word = np.repeat(np.arange(len(each)), sizes)
    n_features = len(rows)
    weights, transition, start = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(gold), bool)
    inner[first] = False
    moves = np.zeros_like(transition)
    np.add.at(moves, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    squares = [np.full_like(x, 1e-3) for x in (weights, transition, start)]
    for _ in range(epochs):
        by_word = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)
        gamma, expected, _ = lattice(by_word[word_at], transition, start, lengths)
        error = -gamma
        error[np.arange(len(gold)), gold] += 1
        word_error = np.stack([np.bincount(word_at, error[:, k], len(each)) for k in range(n_labels)], axis=1)
        push = np.stack([np.bincount(flat, word_error[of_word, k], n_features) for k in range(n_labels)], axis=1)
        for x, g, s in zip((weights, transition, start), (push, moves - expected, error[first].sum(axis=0)), squares):
            g = g / len(texts) - decay * x
            s += g * g
            x += rate * g / np.sqrt(s)
    rows = {name: at for name, at in rows.items() if name[0] != "=" or len(name) == 1} | {
        f"={word}": rows[f"={label}"] for word, label in lexicon.items() if f"={label}" in rows}
    return rows, weights, transition, start


def fit(sample: list[tuple[str, str]], seed: int = 4) -> Model:
    """A model from (text, language) pairs. A third of the sequences switch language at a drawn place."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in sample})
    number = {lang: k for k, lang in enumerate(labels)}
    windows, of = [], []
    for text, lang in sample:
        words = words_of(text)
        at = int(rng.integers(0, max(1, len(words) - WORDS_PER_TEXT + 1)))
        windows.append(words[at:at + WORDS_PER_TEXT])
        of.append(number[lang])
    lexicon = lexicons(windows, of, len(labels))
    texts = [(w, [y] * len(w)) for w, y in zip(windows, of)]
    for k in range(len(texts) // 3):
        i, j = rng.integers(0, len(texts), 2)
        a, b = texts[i], texts[j]
        x, y = (int(rng.integers(0, len(t[0]) + 1)) for t in (a, b))
        texts[k] = (a[0][:x] + b[0][y:], a[1][:x] + b[1][y:])
    if not any(w for w, _ in texts):
        return Model(labels, {}, np.zeros((0, len(labels))), np.zeros((len(labels),) * 2), np.zeros(len(labels)))
    return Model(labels, *train(texts, len(labels), lexicon))


def held_out(id_: Column) -> Column:
    """Whether a document is never learned from; rows without an id may be."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows_of(drawn: DataFrame) -> DataFrame:
    """(__text, __lang, draw) with a window of WORDS_PER_TEXT words, from a place that ``draw`` gives, in place of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            texts = []
            for text, draw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(text)
                at = int(draw * 1e6 % 1 * max(1, len(words) - WORDS_PER_TEXT + 1))
                texts.append(b" ".join(words[at:at + WORDS_PER_TEXT]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], batch.schema.names)

    return drawn.mapInArrow(run, drawn.schema)


def training_sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """A window of up to ``per_language`` training texts of each language, those with the smallest hashes."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    rows = rows.where(~held_out(F.col("__id")) & F.col("__lang").isNotNull())
    sizes = rows.groupBy("__lang").count().collect()  # one row per language
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("__lang") == r["__lang"], min(1.0, 2.0 * per_language / r["count"] + 20.0 / r["count"])).otherwise(share)
    drawn = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64("__id", "__text"), 11) / float(1 << 53)).where(F.col("draw") < share)
    # A drawn row has at most some 2 * per_language + 20 others of its language beside it; only windows of their texts travel.
    least = F.row_number().over(Window.partitionBy("__lang").orderBy("draw"))
    some = windows_of(drawn.select("__text", "__lang", "draw")).withColumn("__at", least).where(F.col("__at") <= per_language)
    return [(r["__text"], r["__lang"]) for r in some.orderBy("draw").collect()]


def mean_marginals(texts: list[np.ndarray], model: Model, emissions: Emissions) -> np.ndarray:
    """Mean label marginals of the words with a letter, by text (as rows of ``emissions``); zero where there is none."""
    return marginals_and_certainty(texts, model, emissions)[0]


def marginals_and_certainty(texts: list[np.ndarray], model: Model, emissions: Emissions) -> tuple[np.ndarray, np.ndarray]:
    """The mean label marginals of each text, and the mean over the same words of each one's largest marginal."""
    n_labels = len(model.labels)
    sure = np.zeros(len(texts))
    out, order = np.zeros((len(texts), n_labels)), sorted((i for i, t in enumerate(texts) if len(t)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        size, to = 0, at
        while to < len(order) and (to == at or size + len(texts[order[to]]) <= CHUNK):
            size += len(texts[order[to]])
            to += 1
        part = [texts[i] for i in order[at:to]]
        lengths = np.array([len(t) for t in part], "int64")
        rows = emissions.rows[np.concatenate(part)]
        gamma, _, _ = lattice(rows[:, :n_labels], model.transition, model.start, lengths, moves=False)
        lettered, first = rows[:, n_labels:], np.cumsum(lengths) - lengths
        count = np.maximum(np.add.reduceat(lettered, first, axis=0), 1)
        out[order[at:to]] = np.add.reduceat(gamma * lettered, first, axis=0) / count
        if n_labels:
            sure[order[at:to]] = np.add.reduceat(gamma.max(axis=1) * lettered[:, 0], first) / count[:, 0]
        at = to
    return out, sure


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sure_col: str | None = None) -> DataFrame:
    """Language of every whole text under a fitted model: id, lang_pred, score, and all other columns of ``docs``.

    lang_pred is the label with the largest mean marginal over words with a letter, score that mean. A null
    text, or one without a letter, is ``und`` with score 0, as is any text under a model without labels. ``sure_col``
    names one more column, the mean over these words of the largest marginal of each: high for text that switches languages clearly.
    """
    names = ["lang_pred", "score", *([sure_col] if sure_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(model)
        for batch in text_slices(batches, at):
            texts = batch.column(at).to_pylist()
            if len(emissions.index) > CACHE_WORDS:
                emissions = Emissions(model)
            rows = []
            for i in range(0, len(texts), SLICE):
                rows += emissions.indexes([words_of(t) if model.labels else [] for t in texts[i:i + SLICE]])
            marginals, certainty = marginals_and_certainty(rows, model, emissions)
            lang, score, sure = [], [], []
            for text, mean, certain in zip(texts, marginals, certainty):
                known = bool(model.labels) and text is not None and any(map(str.isalpha, text)) and mean.any()
                best = int(mean.argmax()) if known else 0
                lang.append(model.labels[best] if known else "und")
                score.append(min(1.0, float(mean[best])) if known else 0.0)
                sure.append(min(1.0, float(certain)) if known else 0.0)
            added = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added[:len(names)]], [*batch.schema.names, *names])

    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double" + (f", `{sure_col}` double" if sure_col else "")
    return docs.mapInArrow(run, schema)


def language(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Learn languages from labelled documents and predict every document: one row per input row.

    Columns: id, held_out, lang_pred, score. A linear-chain field over words, with affix, n-gram and lexicon
    features and learned transitions, is trained on up to ``per_language`` texts of each language (a
    window of WORDS_PER_TEXT words each), never on held-out documents; forward-backward then labels each word of the
    whole text. Only the text enters a prediction. Words are labelled in chunks, so that memory is bounded but for one
    text. Repeated rows give repeated results; other columns are ignored.
    """
    model = fit(training_sample(docs, per_language, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return identify(rows, model, "__id", "__text").select(
        F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "lang_pred", "score")
