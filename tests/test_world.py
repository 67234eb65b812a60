import math

import pytest
from shared import T0, rows
from pyspark.sql import functions as F

from flowrisk.config import WorldConfig
from flowrisk.operators import world as W


def _activity(events):
    return W.window_activity(W.target_activity(events))


def test_actor_window_values(make_events):
    ev = make_events([(0, "a", "GCS_READ", "DATA", "t1"), (2, "a", "GCS_READ", "DATA", "t1"),
                      (4, "a", "SECRET_ACCESS", "SECRET", "t2", {"provenance_level": "WEAK"}),
                      (1, "b", "OTHER", "DATA", "t1")])
    a, b = rows(W.actor_windows(_activity(ev)), "actor_id")
    assert a[2] == 3 and a[3] == ["GCS_READ", "SECRET_ACCESS"] and a[4] == 2
    assert a[5] == pytest.approx(3 / 4)
    assert a[6] == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
    assert a[7] == "WEAK" and b[7] == "NONE" and b[5] == 1.0 and b[6] == 0.0


def test_edges_stay_inside_window_and_keep_self_loops(make_events):
    ev = make_events([(0, "a", "OTHER", "DATA", "t1"), (1, "a", "OTHER", "DATA", "t2"),
                      (2, "a", "OTHER", "SECRET", "t3"), (20, "a", "OTHER", "CONTROL", "t4")])
    got = rows(W.zone_edges(ev).select("source_zone", "target_zone", "target_id", "edge_count"), "target_id")
    assert got == [("DATA", "DATA", "t2", 1), ("DATA", "SECRET", "t3", 1)]


@pytest.mark.parametrize("days,new", [(1, False), (30, False), (31, True)])
def test_edge_novelty_lookback(make_events, days, new):
    ev = make_events([(m + d, "a", "OTHER", z, "t") for d in (0, days * 1440) for m, z in ((0, "DATA"), (1, "SECRET"))])
    e = W.edge_novelty(W.zone_edges(ev))
    assert [r.is_new for r in e.orderBy("window_start").collect()] == [True, new]


def test_slicing_does_not_change_edges(make_events):
    ev = make_events([(i * 13 % 1400, "hot", "OTHER", ["DATA", "SECRET", "CONTROL"][i % 3], f"t{i % 5}") for i in range(90)],
                     minutes=1440)
    cut = W.zone_edges(ev, WorldConfig(window_minutes=1440, slice_minutes=10))
    plain = W.zone_edges(ev, WorldConfig(window_minutes=1440, slice_minutes=1440))
    key = ["window_start", "source_zone", "target_zone", "target_id"]
    assert rows(cut.select(*key, "edge_count"), *key) == rows(plain.select(*key, "edge_count"), *key)


def _pairs(spark, forward, backward, seen):
    return spark.createDataFrame([(T0, 0, 1, float(forward), float(backward), float(seen))],
                                 "window_start timestamp, lo int, hi int, forward double, backward double, observations double")


@pytest.mark.parametrize("f,b,seen,weight", [(8, 2, 60, 1.0), (8, 2, 50, 0.5), (8, 2, 4, 0.0), (8, 0, 60, 0.0), (5, 5, 60, 1.0)])
def test_entropy_production_tiers(spark, f, b, seen, weight):
    want = weight * (f - b) * math.log(f / b) if b else 0.0
    assert W.entropy_production(_pairs(spark, f, b, seen)).first().sigma_coarse == pytest.approx(want)


def test_flux_has_row_for_window_without_edges(make_events):
    ev = make_events([(0, "a", "OTHER", "DATA", "t"), (20, "a", "OTHER", "DATA", "t"), (21, "a", "OTHER", "SECRET", "t")])
    flux = W.zone_flux(ev, W.edge_novelty(W.zone_edges(ev))).orderBy("window_start").collect()
    assert [r.bridge_count for r in flux] == [0, 1]
    assert flux[1].flux_matrix[3][2] == 1.0 and sum(map(sum, flux[0].flux_matrix)) == 0
    assert flux[1].net_currents == {"2_3": -1.0}


def test_ema_matches_recursion(spark):
    sig = [float((i * 7) % 11) for i in range(60)]
    df = spark.createDataFrame([(T0.replace(minute=0), 0.0)], "window_start timestamp, s double").limit(0)
    df = spark.range(len(sig)).select(
        F.timestamp_seconds(F.lit(1704880800) + F.col("id") * 900).alias("window_start"),
        F.element_at(F.array(*[F.lit(x) for x in sig]), (F.col("id") + 1).cast("int")).alias("sigma_coarse"))
    got = [r.delta_f for r in W.ema_delta(df).orderBy("window_start").collect()]
    ema = None
    for s, d in zip(sig, got):
        assert d == pytest.approx(0.0 if ema is None else s - ema)
        ema = s if ema is None else 0.1 * s + 0.9 * ema


def test_novelty_weights(make_events):
    zones = ["DATA", "SECRET", "IDENTITY", "DATA"]
    ev = make_events([(i, "a", "OTHER", z, f"t{i}") for i, z in enumerate(zones)])
    score = W.novelty_scores(W.edge_novelty(W.zone_edges(ev))).first().novelty_score
    assert score == 2.0 + 1.5 + 1.0


def test_ema_is_the_full_recursion_for_any_alpha(spark):
    from dataclasses import replace

    n = 1500
    sigma = [math.sin(i / 7) + i % 5 for i in range(n)]
    flux = spark.createDataFrame([(1_700_000_000 + 900 * i, s) for i, s in enumerate(sigma)], "at long, sigma_coarse double").select(
        F.timestamp_seconds("at").alias("window_start"), "sigma_coarse")
    for alpha in (0.005, 0.1, 0.5):
        got = [r.delta_f for r in W.ema_delta(flux, replace(WorldConfig(), ema_alpha=alpha)).orderBy("window_start").collect()]
        ema = sigma[0]
        assert got[0] == 0.0
        for i in range(1, n):
            assert got[i] == pytest.approx(sigma[i] - ema, abs=1e-9)
            ema = alpha * sigma[i] + (1 - alpha) * ema
