import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from flowrisk.llm import decontamination as D
from flowrisk.llm.queries import op12_decontamination


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(D.WORD, lower)


def brute(docs, items, window=10):
    """(n_words, n_hit, items) of every document, by a look at every place."""
    of = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1) if own and item is not None else 0):
            of.setdefault(tuple(own[i:i + window]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(k) for k in of}:
            for i in range(len(own) - size + 1):
                if (names := of.get(tuple(own[i:i + size]))):
                    hit.update(range(i, i + size))
                    found |= names
        out.append((doc_id, len(own), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def got(found):
    rows = found.collect()
    for r in rows:  # spans are merged and cover the hits
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows), key=str)


def test_suffix_array_and_search():
    rng = np.random.default_rng(5)
    for size, kinds in ((1, 1), (300, 2), (500, 40)):
        lengths = np.array([size, 0, size // 2, size // 2])
        own = [f"w{i}" for i in rng.integers(0, kinds, lengths.sum())]
        own[size + size // 2:] = own[size:size + size // 2]  # two equal pieces
        index = D.fm_index(pa.array(own), lengths)
        s = D.Searcher(index["vocab"], index["counts"], index["n"], 4, index["bits"], index["marks"], index["places"])
        text, at = [], 0
        for k, n in enumerate(lengths):
            text += own[at:at + n] + [k]
            at += n
        order = s.locate(np.arange(len(text)))
        symbol = {w: i + 4 for i, w in enumerate(index["vocab"].to_pylist())}
        coded = [symbol.get(x, x) for x in text]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: coded[i:])
        phrases = [own[i:i + n] for n in (1, 2, 5) for i in range(0, len(own), 7)] + [["none"], [own[0], "none"]]
        phrases = [p for p in phrases if p]
        matrix = np.full((len(phrases), 5), -2)
        for k, p in enumerate(phrases):
            matrix[k, :len(p)] = s.symbols_of(pa.array(sorted(set(p)))).tolist() and [s.symbols_of(pa.array([w]))[0] for w in reversed(p)]
        found = {int(k): sorted(s.locate(np.arange(a, b)).tolist()) for k, a, b in zip(*s.ranges(matrix))}
        want = {k: [i for i in range(len(text)) if text[i:i + len(p)] == p] for k, p in enumerate(phrases)}
        assert found == {k: v for k, v in want.items() if v}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    out = op12_decontamination(spark, sf).collect()
    digest = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out), key=str) == sorted(
        ((i, n, h, len(names), digest(names), h > 0) for i, n, h, names in want), key=str)
    assert any(h for _, _, h, _ in want)


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(3)
    item = [[f"t{i}" for i in rng.integers(0, 60, 40)] for _ in range(5)]
    text = lambda w: " ".join(w)
    items = [("b", text(item[0])), (10, text(item[1])), (9, text(item[2])), ("b", text(item[0])), ("short", "only THREE words"), ("one", "ünique"),
             (None, text(item[3])), ("null", None), ("blank", " .,- "), ("same", text(item[0]))]
    filler = [f"f{i}" for i in range(3000)]
    docs = [(1, text(filler[:50] + item[0][3:25] + filler[50:60])), (2, text(item[1]).upper().replace(" ", "; ")), (3, text(item[0][:9])), (4, None), (5, ""),
            (6, "x only-three/words y Only three, words"), (7, text(item[3])), (8, text(filler + item[2][:12] + filler + item[0][5:20] + ["ünique"] * 3 + filler)),
            (8, text(item[2])), (8, text(item[2])), (None, text(item[2][20:])), (9, " ... "), (10, text(item[0][10:20] + item[1][10:21]))]
    return docs, [(None if i is None else str(i), t) for i, t in items]


def test_odd_rows(spark, docs_of, cases):
    docs, items = cases
    table = spark.createDataFrame(items, "item_id string, text string")
    assert got(D.contamination(docs_of(docs, extra=True), table)) == brute(docs, items)
    assert got(D.contamination(docs_of(docs), table.limit(0))) == brute(docs, [])
    assert got(D.contamination(docs_of([]), table)) == []


def test_pieces_shards_and_blocks(spark, docs_of, cases, monkeypatch):
    """Small pieces, shards, blocks and batches give the same."""
    docs, items = cases
    for name, value in (("PIECE_WORDS", 25), ("SHARD_WORDS", 400), ("BLOCK_WINDOWS", 7), ("LOCATED", 5)):
        monkeypatch.setattr(D, name, value)
    assert got(D.contamination(docs_of(docs), spark.createDataFrame(items, "item_id string, text string"))) == brute(docs, items)
    assert got(D.contamination(docs_of(docs), spark.createDataFrame(items, "item_id string, text string"), window=3)) == brute(docs, items, 3)


def test_removal(spark, docs_of):
    docs = docs_of([(1, "Keep this: alpha beta, gamma! and that. Alpha  BETA gamma"), (2, "nothing here"), (3, None)])
    found = D.contamination(docs, spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string"))
    clean = {r.doc_id: r.text for r in D.remove_spans(docs, found).collect()}
    assert clean == {1: "Keep this: ! and that. ", 2: "nothing here", 3: None}
