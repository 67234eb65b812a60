import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import fingerprint, groups

from flowrisk.llm.components import components
from flowrisk.llm.simhash import Ring, link, near_duplicates


def check(out, rows):
    fps = [fingerprint(t) for _, t in rows]
    of = groups(set(fps), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (doc_id, _), fp in zip(rows, fps):
        if doc_id is not None:
            least[of[fp]] = min(doc_id, least.get(of[fp], doc_id))
    want = sorted(((d, f"{fp:016x}", least.get(of[fp])) for (d, _), fp in zip(rows, fps)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=str) == want


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    check(near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_links_of_planted_fingerprints(spark):
    """Chains, a dense group around one centre, and pairs at every distance from 1 to 7."""
    rng = random.Random(3)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps, centre = set(), rng.getrandbits(64)
    fps.update(flip(centre, rng.randint(0, 4)) for _ in range(150))
    for _ in range(60):
        a = rng.getrandbits(64)
        fps.update((a, flip(a, rng.randint(1, 7))))
    chain = rng.getrandbits(64)
    for _ in range(30):
        fps.add(chain)
        chain = flip(chain, 4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r.fp: r.component for r in link(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    want = groups({signed(x) for x in fps}, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {x: got.get(x, x) for x in want} == want


def test_some_chain_holds_within_the_budget(spark):
    rng, ring = np.random.default_rng(5), Ring()
    pairs = []
    for n in range(9):
        for _ in range(40):
            a = int(rng.integers(-2**63, 2**63))
            pairs.append((a, a ^ (sum(1 << int(b) for b in rng.choice(63, n, replace=False))), n))
    df = spark.createDataFrame(pairs, "a long, b long, n int")
    any_start = F.greatest(*(ring.chain_holds(F.col("a"), F.col("b"), F.lit(s)).cast("int") for s in range(5)))
    for r in df.select("n", any_start.alias("ok")).collect():
        assert r.ok == (r.n <= 4) or r.n > 4
        assert r.n <= 4 or not r.ok


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(2000 + i, 2001 + i) for i in range(120)]
    nodes, beside = {x for e in edges for x in e}, {}
    for a, b in edges:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    want = groups(nodes, lambda a, b: b in beside[a])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {x: got.get(x, x) for x in nodes} == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_odd_rows(docs_of, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    check(near_duplicates(docs_of(odd_rows, extra=True)).collect(), rows)
    assert near_duplicates(docs_of([])).collect() == []


def test_keys_are_not_broadcast(spark, monkeypatch):
    """280,000 fingerprints are 2 MB and their exploded keys ten million rows, which no driver should hold."""
    from flowrisk.llm import simhash

    class Planned(Exception):
        pass

    def plan(df, name):
        raise Planned(df._jdf.queryExecution().executedPlan().toString())

    fps = simhash.materialize(spark.range(280_000).select(F.xxhash64("id").alias("fp")), "many-fps")
    monkeypatch.setattr(simhash, "materialize", plan)
    with pytest.raises(Planned) as found:
        link(fps)
    assert "Generate" in str(found.value) and "BroadcastExchange" not in str(found.value)
