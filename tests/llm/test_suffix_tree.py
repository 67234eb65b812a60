import math
import zlib
from collections import Counter

import numpy as np
import pytest

from flowrisk.llm import suffix_tree
from flowrisk.llm.suffix_tree import score


def words(text):
    return [*(text or "").encode().lower().split(), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Brute:
    """The same tree with plain dictionaries, context by context."""

    def __init__(self, texts, depth=3, gain=3.0):
        seqs = [words(t) for t in texts]
        self.c, self.n = Counter(w for s in seqs for w in s), sum(map(len, seqs))
        self.below = self.n + 0.1 * (len(self.c) + 1)
        frequent = {w for w, k in self.c.items() if w is None or k >= max(2.0, suffix_tree.WORD_SHARE * self.n)}
        open_ = {(w,): k for w, k in self.c.items() if w is not None and k >= max(2.0, suffix_tree.CONTEXT_SHARE * self.n)}
        self.nodes = {}
        for d in range(1, depth + 1):
            follow = Counter(tuple(s[i - d:i + 1]) for s in seqs for i in range(d, len(s)) if tuple(s[i - d:i]) in open_ and s[i] in frequent)
            follow = {k: n for k, n in follow.items() if n >= max(2.0, suffix_tree.PAIR_SHARE * self.n)}
            new = {}
            for ctx, total in open_.items():
                nxt = {k[-1]: n for k, n in follow.items() if k[:-1] == ctx}
                if nxt:
                    rest = 1 - sum(n - 0.5 for n in nxt.values()) / total
                    ratio = sum(n * math.log(((n - 0.5) / total + rest * self.p(ctx[1:], w)) / self.p(ctx[1:], w)) for w, n in nxt.items())
                    left = total - sum(nxt.values())
                    ratio += left * math.log(rest) if left else 0
                    if ratio >= gain * len(nxt):
                        new[ctx] = (total, nxt, rest)
            self.nodes.update(new)
            open_ = {k: n for k, n in follow.items() if k[-1] is not None}

    def p(self, ctx, w):
        p = (self.c[w] + 0.1) / self.below
        for d in range(1, len(ctx) + 1):
            if (node := self.nodes.get(tuple(ctx[len(ctx) - d:]))):
                p = max(0.0, node[1].get(w, 0.5) - 0.5) / node[0] + node[2] * p
        return p

    def log10(self, text, depth=3):
        s = words(text)
        return sum(math.log10(self.p(s[max(0, i - depth):i], w)) for i, w in enumerate(s))


def check(out, rows):
    model = Brute([t for i, t in rows if not held(i)])
    want = sorted((str(i), held(i), len(words(t)), sum(model.c[w] > 0 for w in words(t)), model.n) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out) == want
    base = lambda t: sum(math.log10((model.c[w] + 0.1) / model.below) for w in words(t))
    texts = {}
    for i, t in rows:
        texts.setdefault(str(i), []).append((base(t), model.log10(t)))
    for r in out:
        assert any(r.base_score == pytest.approx(b, rel=1e-9, abs=1e-9) and r.score == pytest.approx(m, rel=1e-6) for b, m in texts[str(r.doc_id)])
    return model


def test_equals_plain_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = check(score(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert {len(ctx) for ctx in model.nodes} == {1, 2, 3}
    for ctx in list(model.nodes)[:20]:  # a distribution: known words and one unknown word
        assert sum(model.p(ctx, w) for w in [*model.c, b"\0"]) == pytest.approx(1)


def test_contexts_help_on_texts_kept_out(spark):
    out = score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sum(r.score for r in out if r.held_out) > 0.9 * sum(r.base_score for r in out if r.held_out)


def test_words_that_tasks_do_not_hold(docs_of, monkeypatch):
    """With high thresholds most words are joined to their counts instead."""
    for name, share in (("WORD_SHARE", 0.02), ("CONTEXT_SHARE", 0.03), ("PAIR_SHARE", 0.005)):
        monkeypatch.setattr(suffix_tree, name, share)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.5, 40) % 50) + " the same end") for i in range(150)]
    check(score(docs_of(rows)).collect(), rows)


def test_odd_rows(docs_of, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows if r[0] != 5] + [(5, "long " * 3000)]
    check(score(docs_of(rows, extra=True)).collect(), rows)
    assert score(docs_of([])).collect() == []
    only_held = [(i, "kept out") for i in range(200) if held(i)]
    assert {r.base_score for r in score(docs_of(only_held)).collect()} == {0.0}


def test_rare_contexts_stay_in_a_large_corpus(docs_of):
    """Over a million tokens, pairs that occur three times are contexts and entries as in a small corpus."""
    free = [i for i in range(200) if not held(i)]
    rows = [(i, "aa bb cc dd " * 20_000) for i in free[:16]] + [(i, "xq yq zq") for i in free[16:19]]
    out = {r.doc_id: r for r in score(docs_of(rows)).collect()}
    assert out[free[0]].train_tokens > 1_200_000
    model = check(list(out.values()), rows)
    assert {(b"xq",), (b"yq",)} <= set(model.nodes) and all(out[i].score > out[i].base_score + 5 for i in free[16:19])


def test_what_is_written_is_less_than_the_texts(spark, monkeypatch, tmp_path):
    """Chunks, and replies of all levels; requests are not written."""
    from flowrisk import session
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(1)
    assert score(docs).count() == docs.count()
    written = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert 0 < written < sum(len((r.text or "").encode()) for r in docs.collect())


def test_chunks_are_bounded_by_their_bytes(docs_of):
    docs = docs_of([(i, f"w{i:02d} x{i % 7} " * 150_000) for i in range(16)]).repartition(1)
    rows = docs.selectExpr("doc_id AS __id", "false AS held", "text AS __text")
    sizes = suffix_tree.chunks(rows).selectExpr("size(lengths) AS texts").collect()
    assert sum(r.texts for r in sizes) == 16 and max(r.texts for r in sizes) <= 8  # of 1.05 MB
