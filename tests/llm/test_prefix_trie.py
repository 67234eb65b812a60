import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from flowrisk.llm import prefix_trie as T
from flowrisk.llm.queries import op13_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All nodes from dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        words = len(node[-1][1].encode().split()) if node else 0
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * words
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if full[c] == node)))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = op13_conversation_trie(spark, f"/root/testdata/{sf}")
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(out) == brute(rows)


def alike(seed, n=150, turns=9, kinds=2):
    """Conversations of few kinds of turns, which share many prefixes."""
    rng = np.random.default_rng(seed)
    return [(int(c), t, "user" if t % 2 else "bot", "word " * int(rng.integers(0, kinds))) for c in rng.choice(2000, n, replace=False) for t in range(int(rng.integers(1, turns)))]


@pytest.mark.parametrize("turns,layer", [(1, 1 << 16), (20, 1 << 16), (3, 2), (10_000, 3), (5, 4)])
def test_bursts_and_layers_give_the_same(spark, monkeypatch, turns, layer):
    monkeypatch.setattr(T, "CONTAINER_TURNS", turns)
    monkeypatch.setattr(T, "LAYER_TURNS", layer)
    rows = alike(turns) + [(c, t, "user", "the same beginning") for c in range(3000, 3040) for t in range(5)] + [(3001, 5, "bot", "one more")]
    assert got(T.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (1, None, None, None), (1, 2, "user", "x"), (1, 2, "bot", "x"), (1, 2, "bot", "x"), (20, 0, "u", "a b c"), (25, 0, "", ""),
            (25, None, "u", "long " * 50_000), (2**40, 3, "u", "a b c"), (41, 1, "1:", "a"), (42, 1, "1", ":a"), (-3, 0, "u", "a"), (60, 0, "user", " \t"), (61, 1, "user", "z")]
    rows += [(100 + 20 * i, t, "user", f"turn {t}") for i in range(3) for t in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from pyspark.sql import functions as F
    df = df.withColumns({c: F.lit("x") for c in ("c", "pos", "id", "words", "head", "path", "e1", "n", "least", "k", "part")})
    want = brute([r for r in rows if r[0] != -3])
    assert got(T.conversation_trie(df.where("conv_id is null or conv_id <> -3"))) == want
    assert len(got(T.conversation_trie(df))) >= len(want)
    assert got(T.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    turnless = [(c, 0, "user", "only") for c in (1, 2, 3, 5, 7) if zlib.crc32(str(c).encode()) % 4]
    assert got(T.conversation_trie(spark.createDataFrame(turnless, SCHEMA))) == brute(turnless)


def test_one_conversation_over_many_tasks(spark):
    """Numbers of turns go on from task to task, also where all turns are equal."""
    rows = [(7, t // 40, "user", f"t{t % 3}") for t in range(4000)] + [(8, 1, "user", "x")] * 2000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        out = T.numbered(spark.createDataFrame(rows, SCHEMA)).collect()
        for c, n in ((7, 4000), (8, 2000)):
            assert sorted(r.pos for r in out if r.c == c) == list(range(n))
        assert got(T.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
