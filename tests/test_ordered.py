"""Skew-safe ordered operators against plain Python on random data with one dominant key."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowrisk.operators import ordered as O


def _data(seed, n=400):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", rng.randrange(1000), i,
             rng.choice([None, "a", "b", "c"])) for i in range(n)]


def _by_key(data):
    out = {}
    for k, t, i, v in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(k, []).append((t, i, v))
    return out


def _slice():
    return F.floor(F.col("t") / 37).cast("long")


def test_nearest_value_both_directions(spark):
    data = _data(1)
    df = spark.createDataFrame(data, "k string, t int, i int, v string")
    for forward in (False, True):
        got = O.nearest_value(df, ["k"], ["t", "i"], F.col("v"), "n", _slice(), forward)
        got = {r.i: r.n for r in got.collect()}
        for seq in _by_key(data).values():
            line = seq[::-1] if forward else seq
            last = None
            for _, i, v in line:
                assert got[i] == last
                last = v if v is not None else last


def test_positions_and_totals(spark):
    data = _data(2)
    df = spark.createDataFrame(data, "k string, t int, i int, v string")
    got = O.running_totals(df, ["k"], ["t", "i"], {"s": F.col("i")}, _slice())
    got = {r.i: r.s for r in got.collect()}
    placed = {r.i: r.position for r in O.with_position(df, ["k"], ["t", "i"], slice_by=_slice()).collect()}
    for seq in _by_key(data).values():
        total = 0
        for at, (_, i, _v) in enumerate(seq, 1):
            assert got[i] == total and placed[i] == at
            total += i


def test_asof_lookup_all_modes(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(300), i) for i in range(150)]
    right = [(rng.choice("ab"), rng.randrange(300), i) for i in range(60)]
    ldf = spark.createDataFrame(left, "k string, at int, id int")
    rdf = spark.createDataFrame(right, "k string, pos int, rid int")
    for forward in (False, True):
        for strict in (False, True):
            got = O.asof_lookup(ldf, rdf, ["k"], "at", "pos", ["rid"], "m",
                                lambda c: F.floor(c / 20).cast("long"), forward, strict)
            got = {r.id: (r.m["at"] if r.m else None) for r in got.collect()}
            for k, at, i in left:
                ok = [p for rk, p, _ in right if rk == k and (
                    (p < at if strict else p <= at) if not forward else (p > at if strict else p >= at))]
                assert got[i] == ((min(ok) if forward else max(ok)) if ok else None)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.floats(0, 1))
def test_percentiles_match_numpy(spark, values, p):
    import numpy as np
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = O.linear_percentiles(df, [], "v", {"q": p}).first()
    assert row.n == len(values)
    assert abs(row.q - np.percentile(values, p * 100)) < 1e-9


def test_rank_with_heavy_value(spark):
    data = [("a", 1.0)] * 500 + [("a", float(i)) for i in range(100)] + [("b", 7.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r.m for r in O.values_at_ranks(df, ["k"], "v", {"m": F.expr("n div 2")}, bins=8).collect()}
    for k in "ab":
        s = sorted(v for kk, v in data if kk == k)
        assert got[k] == s[len(s) // 2]


def test_ranks_with_null_keys_and_heavy_tails(spark):
    rows = [(None if i % 2 else "a", float(i)) for i in range(4000)] + [("a", 1e12)]
    got = {r.k: (r.n, r.mid, r.top) for r in O.values_at_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {
        "mid": F.col("n") / 2, "top": F.col("n") - 1}).collect()}
    assert got == {None: (2000, 2001.0, 3999.0), "a": (2001, 2000.0, 1e12)}


def test_ranks_of_any_numbers(spark):
    """Every order of magnitude, both signs, zero, infinities, not a number, long numbers; with coarse and fine digits."""
    import random
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1070, 1020) for _ in range(300)] + [0.0, float("inf"), float("-inf"), 1e308, -1e308] * 3
    values += [1.0 + k * 2.0 ** -52 for k in range(200)] * 2
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    places = {f"r{i}": i for i in (0, 3, 17, 150, 300, 444, 555, len(values) - 4, len(values) - 1)}
    for bins, largest in ((4096, 1000), (64, 10), (64, 0)):
        got = O.values_at_ranks(df, [], "v", {n: F.lit(i) for n, i in places.items()}, bins, largest).first()
        assert {n: got[n] for n in places} == {n: sorted(values)[i] for n, i in places.items()}
    whole = spark.range(2**62, 2**62 + 500).select(F.col("id").alias("v"))
    assert O.values_at_ranks(whole, [], "v", {"m": F.expr("n div 3")}).first().m == 2**62 + 166
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert str(O.values_at_ranks(odd, [], "v", {"m": F.lit(2)}).first().m) == "nan"


def test_running_totals_carry_over_slices_of_a_null_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(40)], "k string, t int")
    got = O.running_totals(df, ["k"], ["t"], {"s": F.col("t")}, F.floor(F.col("t") / 10)).collect()
    assert all(r.s == r.t * (r.t - 1) // 2 for r in got)
    last = O.with_previous(df, ["k"], ["t"], {"p": "t"}, F.floor(F.col("t") / 10)).collect()
    assert all(r.p == (r.t - 1 if r.t else None) for r in last)


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_only_crowded_keys_are_sliced(spark):
    """Keys of few rows need no rows that carry state from slice to slice; the crowded one does."""
    data = _data(4)
    df = spark.createDataFrame(data, "k string, t int, i int, v string")
    step = lambda rows, piece: O.with_position(rows, ["k"], ["t", "i"], "position", piece)
    want = {i: at for seq in _by_key(data).values() for at, (_, i, _v) in enumerate(seq, 1)}
    for most, cut in ((1000, False), (100, True)):
        placed = O.slice_crowded(df, ["k"], _slice(), step, most=most)
        assert {r.i: r.position for r in placed.collect()} == want and (_joins(placed) > 0) == cut
    assert [r.k for r in O.crowded_keys(df, ["k"], 100).collect()] == ["hot"]


def test_asof_lookup_slices_crowded_keys_only(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None, (i * 37) % 500, i) for i in range(300)], "k string, at int, id int")
    cut = lambda c: F.floor(c / 20).cast("long")
    want = {r.id: r.f["at"] for r in O.asof_lookup(df, df, ["k"], "at", "at", [], "f", None, strict=True).collect() if r.f}
    for most in (50, 150, 1000):
        got = O.asof_lookup(df, df, ["k"], "at", "at", [], "f", cut, strict=True, most=most)
        assert {r.id: r.f["at"] for r in got.collect() if r.f} == want
