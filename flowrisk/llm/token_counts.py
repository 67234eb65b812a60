"""Operator 1: token counts by greedy longest match, in time linear in the text."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import byte_words

END = 256  # the symbol after the last byte of a word
CACHE_WORDS = 400_000


class Automaton:
    """Vocabulary trie whose failure links carry the number of pieces they pop.

    ``children[v]`` maps a symbol to the next node. When a node has no way on, the pieces
    that greedy matching would have cut off so far are known in advance: ``pops[v]`` of them,
    after which matching goes on at ``fail[v]``. Every symbol is thus read once, and no piece
    is ever built. ``fail`` is -1 where no piece fits; such a word is one unknown token.
    """

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                nxt = self.children[node].get(symbol)
                if nxt is None:
                    nxt = self.children[node][symbol] = len(self.children)
                    self.children.append({})
                    final.append(False)
                node = nxt
            final[node] = bool(node)
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        level = [0]
        while level:  # by depth: a link leads to a shallower node
            below = []
            for parent in level:
                for symbol, node in self.children[parent].items():
                    below.append(node)
                    if final[node]:
                        self.fail[node], self.pops[node] = 0, 1
                        continue
                    back, popped = self.fail[parent], self.pops[parent]
                    while back >= 0 and symbol not in self.children[back]:
                        popped += self.pops[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[node], self.pops[node] = self.children[back][symbol], popped
            level = below

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; 1 if the vocabulary can't spell it, 0 if it is empty."""
        if not word:
            return 0
        children, fail, pops = self.children, self.fail, self.pops
        node = total = 0
        for symbol in chain(word, (END,)):
            while (nxt := children[node].get(symbol)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nxt
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary with word ends, as symbols. Special tokens aren't pieces."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    special, alphabet, pieces = {t["content"] for t in content["added_tokens"]}, byte_alphabet(), []
    for piece in content["model"]["vocab"]:
        if piece not in special:
            body = piece.removesuffix("</w>")
            pieces.append((*(alphabet[c] for c in body), *((END,) if body != piece else ())))
    return pieces


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, bytes and greedy word pieces of every text: one row per input row.

    A word is a run without ASCII white space, A-Z in lower case; each is matched on its own
    against the vocabulary at ``vocab_path`` (a path every executor has). Null and blank texts
    have no words and no tokens. Repeated rows give repeated results; other columns are ignored,
    whatever they are called. One pass without a shuffle; a task keeps the automaton and at most
    CACHE_WORDS word counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Automaton(vocabulary(vocab_path)), {}
        for batch in batches:
            n_words, n_bytes, n_tokens = [], [], []
            for text in batch.column(1).to_pylist():
                words = byte_words(text)
                for w in set(words).difference(seen):
                    seen[w] = automaton.count(w)
                n_words.append(len(words))
                n_bytes.append(len((text or "").encode()))
                n_tokens.append(sum(map(seen.__getitem__, words)))
                if len(seen) > CACHE_WORDS:
                    seen.clear()
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_bytes, n_tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], ["__id", "n_words", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"__id {kind}, n_words long, n_bytes long, n_tokens long").withColumnRenamed("__id", id_col)
