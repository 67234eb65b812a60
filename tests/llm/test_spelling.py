import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowrisk.llm import spelling as S
from flowrisk.llm.queries import op11_spelling


def near(a, b):
    """Whether one edit makes a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def neighbours(words):
    """Near words of each, by their deletions."""
    by, out = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1:]), set()).add(w)
    for w in words:
        for i in range(len(w)):
            out[w] |= by[w[:i], w[i + 1:]] - {w}
            if (cut := w[:i] + w[i + 1:]) in out:
                out[w].add(cut)
                out[cut].add(w)
    return out


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    others, form = neighbours(n), {}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), k, len(others[w]), n.get(form.get(w))) for w, k in n.items()}


def got(out):
    rows = out.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_whole_table(spark):
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])
    assert got(op11_spelling(spark, "/root/testdata/sf0.01")) == want
    assert any(f for f, *_ in want.values())


def test_scan_of_a_list():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 4):
        regions = sorted({bytes(rng.integers(97, 100, size + int(rng.integers(2))).astype("u1")) for _ in range(200)})
        for cut in (1, 2, 99):
            found = {(i, int(j)) for i, js in S.near_in_list(regions, size, cut) for j in js}
            want = {(i, j) for i, x in enumerate(regions) for j, y in enumerate(regions)
                    if near(x.decode(), y.decode()) and not (len(x) > size and len(y) > size) and (x[:cut] != y[:cut] or len(x) < cut or len(y) < cut)}
            assert found == want


@pytest.mark.parametrize("most", [3, 2048])
def test_every_split_finds_the_same(docs_of, monkeypatch, most):
    monkeypatch.setattr(S, "BUCKET_WORDS", most)
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abé"), rng.integers(6, 10))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 60)) + " Chained chainde " * (i % 3)) for i in range(120)]
    assert got(S.variants(docs_of(rows))) == brute(rows)


def test_forms_lead_to_roots(docs_of):
    rows = [(None, "walking " * 130 + "walkimg " * 26 + "walkimgs " * 5 + "walkinx " * 5 + "talking " * 130)]
    out = got(S.variants(docs_of(rows)))
    assert out == brute(rows)
    assert out["walkimgs"][:2] == ("walkimg", "walking") and out["walkinx"][0] == "walking" and out["talking"][0] is None


def test_odd_rows(docs_of, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows] + [(20 + i, "Ünïcode ünïcode naïveté x漢字×÷ word's " * 3) for i in range(4)]
    assert got(S.variants(docs_of(rows, extra=True))) == brute(rows)
    assert S.variants(docs_of([])).collect() == [] and S.variants(docs_of([(1, None), (2, "short words")])).collect() == []


def test_a_letter_less():
    for doc_id in range(3000):
        h = zlib.crc32(f"{doc_id}:ébauche".encode())
        want = "ébauche" if h % 199 else "ébauche"[:h % 7] + "ébauche"[h % 7 + 1:]
        assert S.spelled(doc_id, "ébauche".encode("latin-1")).decode("latin-1") == want
