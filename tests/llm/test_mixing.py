from collections import Counter, defaultdict

from brute import wanted

from flowrisk.llm.mixing import mix


def check(out, rows):
    sizes, size_of = Counter(), Counter()
    for doc_id, text, source in rows:
        n = len((text or "").encode().split())
        sizes[doc_id, n, source] += 1
        size_of[source] += n
    assert Counter((r.doc_id, r.size, r.source) for r in out) == sizes
    share, taken, most = wanted(size_of), Counter(), defaultdict(int)
    for r in out:
        assert r.source_size == size_of[r.source] and abs(r.target - share[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        ratio = share[r.source] / max(size_of[r.source], 1)
        assert r.size == 0 or int(ratio - 1e-6) <= r.taken // r.size <= int(ratio + 1e-6) + 1
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - share[s]) <= most[s] + 1e-6 for s in size_of)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mix(docs).collect()
    check(out, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert sorted(mix(docs.repartition(3)).collect()) == sorted(out)


def test_tree_of_several_levels_and_hot_source(docs_of):
    rows = [(i, "w " * (i * 7919 % 97 + 1), "a" if i % 3 else f"s{i % 7}") for i in range(20_000)]
    out = mix(docs_of(rows)).collect()
    check(out, rows)
    ups = [r.taken // r.size for r in out if r.source == "s3"]
    assert len(set(ups)) <= 2


def test_capped_source(docs_of):
    rows = [(0, "one", "a")] + [(i, "w " * 50, "b") for i in range(1, 40)]
    out = mix(docs_of(rows)).collect()
    check(out, rows)
    assert next(r.taken for r in out if r.source == "a") == 3


def test_odd_rows(docs_of, odd_rows):
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s1") for r in odd_rows] + [(20, None, "empty source")]
    check(mix(docs_of([(*r, "en") for r in rows], extra=True)).collect(), rows)
    check(mix(docs_of([(1, None), (2, "")])).collect(), [(1, None, "s1"), (2, "", "s1")])
    assert mix(docs_of([])).collect() == []


def test_many_equal_rows_are_numbered(spark, monkeypatch):
    from flowrisk.llm import common
    monkeypatch.setattr(common, "COPIES", 7)
    rows = [(1, "a")] * 40 + [(2, "b")] * 7 + [(3, None)] * 8 + [(None, None)]
    out = common.number_copies(spark.createDataFrame(rows, "i int, t string"), "copy").collect()
    assert sorted((str(r.i), r["copy"]) for r in out) == sorted((str(i), k) for i, n in ((1, 40), (2, 7), (3, 8), (None, 1)) for k in range(n))
