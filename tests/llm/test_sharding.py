import zlib
from collections import Counter, defaultdict

from flowrisk.llm.sharding import shard_rows


def sizes(out, shards):
    by, slots = Counter(), defaultdict(list)
    for r in out:
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(by) <= set(range(shards))
    return [by[k] for k in range(shards)]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out, rows = shard_rows(docs).collect(), docs.collect()
    want = {r.doc_id: (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in rows}
    assert len(out) == len(rows) and {r.doc_id: (r.size, r.text_crc32) for r in out} == want
    by = sizes(out, 8)
    assert max(by) - min(by) <= 2 * max(s for s, _ in want.values())
    assert sorted(shard_rows(docs.repartition(5)).collect()) == sorted(out)


def test_hot_group_and_small_cells(docs_of):
    rows = [(i, "copy of one text" if i % 3 else f"text {i}") for i in range(3000)]
    by = sizes(shard_rows(docs_of(rows), rows_per_cell=50).collect(), 8)
    assert max(by) - min(by) <= 60 and sum(by) == sum(len(t) + 1 for _, t in rows)


def test_small_groups_stay_together(docs_of):
    rows = [(i, f"text of group {i // 2:05d}") for i in range(8000)]
    out, where = shard_rows(docs_of(rows)).collect(), defaultdict(set)
    for r in out:
        where[r.text_crc32].add(r.shard)
    assert all(len(w) == 1 for w in where.values())


def test_odd_rows(docs_of, odd_rows):
    out = shard_rows(docs_of(odd_rows, extra=True)).collect()
    sizes(out, 8)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode())) for r in odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert {r.law for r in out} == {"bytes"} and shard_rows(docs_of([])).collect() == []
