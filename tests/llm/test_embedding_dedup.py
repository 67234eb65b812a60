import numpy as np
from pyspark.sql import functions as F
from brute import groups

from flowrisk.llm.embedding_dedup import hadamard, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """{id: (links, component)} for unique ids."""
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, "float64")
            good[i] = (label, x / np.linalg.norm(x))
    near = {i: {j for j in good if j != i and good[i][0] == good[j][0] and len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] >= 0.98} for i in good}
    of = groups(good, lambda a, b: b in near[a]) if good else {}
    return {i: (len(near.get(i, ())), of.get(i, i)) for i, _, _ in rows}


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([tuple(r) for r in df.collect()])
    out = near_duplicates(df).collect()
    assert len(out) == len(want)
    got, most = sum(r.n_links for r in out), sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in out) and got >= 0.97 * most
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_planted_groups(spark):
    rng, rows = np.random.default_rng(2), []
    for g in range(60):
        centre = rng.normal(size=64)
        for k in range(6):
            rows.append((len(rows), [float(x) for x in np.float32(centre + 0.08 * rng.normal(size=64))], g % 3))
    hot = [float(x) for x in np.float32(rng.normal(size=64))]
    rows += [(1000 + i, hot, 1) for i in range(300)] + [(2000 + i, hot, 2) for i in range(5)]
    df, want = spark.createDataFrame(rows, SCHEMA), brute(rows)
    out = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert sum(n for n, _ in want.values()) > 300 * 299
    found = sum(out[i].n_links for i in want if i < 1000) / sum(want[i][0] for i in want if i < 1000)
    assert found >= 0.97 and all(out[i].n_links <= n for i, (n, _) in want.items())
    assert all((out[i].n_links, out[i].component_id) == want[i] for i in want if i >= 1000)


def test_odd_rows(spark):
    v = [0.5, -1.0, 2.0]
    rows = [(1, v, 1), (1, v, 1), (2, [1.0, -2.0, 4.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1),
            (8, [None, 1.0, 2.0], 1), (9, [float("nan"), 1.0, 2.0], 1), (10, [float("inf"), 1.0, 2.0], 1), (None, v, 1), (11, [3e38, -3e38, 3e38], 1),
            (12, [1.0, -1.0, 1.0], 1), (13, [1.0, -1.0], 1), (14, [2.0, -2.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("cls", "n", "table", "vector", "least", "x", "y")})
    out = {(r.vec_id, i): r for i, r in enumerate(sorted(near_duplicates(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0)))}
    assert len(out) == len(rows)
    links = {}
    for (i, _), r in out.items():
        links.setdefault(i, []).append((r.n_links, r.component_id))
    assert links[1] == [(3, 1), (3, 1)] and links[2] == [(3, 1)] and links[None] == [(3, 1)]
    assert all(links[i] == [(0, i)] for i in (3, 4, 5, 6, 7, 8, 9, 10)) and links[11] == [(1, 11)] and links[13] == [(1, 13)] and links[14] == [(1, 13)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hadamard_is_orthogonal():
    h = hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)
