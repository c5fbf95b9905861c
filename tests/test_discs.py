"""Counts within a radius: many copies, odd coordinates and repeated keys, against pairs and SQL."""

import duckdb
import numpy as np
import pytest

from meridian.operators import discs
from meridian.plans import catalogue

PART = "p_partkey long, p_size int, p_retailprice double"


def _within(x, y, w, radius):
    return [int(w[(x - a) * (x - a) + (y - b) * (y - b) <= radius * radius].sum()) for a, b in zip(x, y, strict=True)]


def _odd_parts():
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(1, 30)), 900 + int(rng.integers(0, 400)) / 10) for i in range(300)]
    odd = [(300, None, 905.0), (301, 5, None), (302, 5, float("nan")), (303, 5, float("inf")), (304, 7, 1e30), (305, 7, -1e30), (306, 0, -0.0), (307, 0, 0.0), (None, 3, 905.0)]
    return rows + odd + [(300, 12, 920.0), (300, 12, 920.0), (300, 29, 1500.0), (5, 29, 1502.0)]  # keys that come again, here and there


def _against_sql(spark, name, folder):
    spark.createDataFrame(_odd_parts(), PART).write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    want = con.sql(catalogue.ORACLE[name])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def _many_copies(spark, folder):
    """300,000 parts at 35 places, which are 2e10 pairs and more; (count of each place)."""
    spark.sql("select id as p_partkey, cast(id % 5 as int) as p_size, 900 + (id % 7) * 1.5D as p_retailprice from range(300000)").write.parquet(f"{folder}/part.parquet")
    ids = np.arange(300_000)
    places, w = np.unique(np.stack([ids % 5, 900 + (ids % 7) * 1.5]), axis=1, return_counts=True)
    return {(x, y): n for x, y, n in zip(*places, _within(*places, w, 5.0), strict=True)}


@pytest.mark.parametrize("far", [0.0, 1e6, -1e15])
@pytest.mark.parametrize("near", [50, 1 << 21])
def test_count_within(monkeypatch, far, near):
    monkeypatch.setattr(discs, "NEAR", near)
    rng = np.random.default_rng(2)
    for radius, grain in ((5.0, 1.0), (0.3, 0.1), (7.3, 1e-6)):
        x, y = (np.round(rng.uniform(-3, 3, 400) * radius / grain) * grain + far for _ in range(2))
        unit, w, home = np.sort(rng.integers(0, 3, 400)), rng.integers(1, 5, 400), rng.random(400) < 0.6
        want = np.zeros(400, np.int64)
        for u in range(3):
            want[unit == u] = _within(x[unit == u], y[unit == u], w[unit == u], radius)
        assert discs.count_within(unit, x, y, w, home, radius).tolist() == want[home].tolist()


def test_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(discs, "FINE", 20)
    rng = np.random.default_rng(6)
    x, y = np.concatenate([rng.normal(size=(2, 500)) * 3, rng.uniform(-60, 60, (2, 500)), np.full((2, 7), 8.0)], axis=1)
    got = discs.place_density(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double"), 2.5).collect()
    assert {(r["x"], r["y"]): r["n"] for r in got} == dict(zip(zip(x, y, strict=True), _within(x, y, np.ones(len(x)), 2.5), strict=True))
    assert len(got) == 1001
    assert discs.place_density(spark.createDataFrame([], "x double, y double"), 2.5).count() == 0


def test_hot_spots_of_odd_parts(spark, tmp_path):
    _against_sql(spark, "hot_spots", tmp_path)


def test_hot_spots_of_many_copies(spark, tmp_path):
    counts = _many_copies(spark, tmp_path)
    best = max(counts.values())
    got = [tuple(r) for r in catalogue.QUERIES["hot_spots"](spark, str(tmp_path)).collect()]
    assert got == [(min(i for i in range(35) if counts[i % 5, 900 + (i % 7) * 1.5] == best), best)]


def test_incident_density_of_odd_parts(spark, tmp_path):
    _against_sql(spark, "incident_density", tmp_path)


def test_incident_density_of_many_copies(spark, tmp_path):
    counts = _many_copies(spark, tmp_path)
    got = catalogue.QUERIES["incident_density"](spark, str(tmp_path)).collect()
    assert len(got) == 300_000
    assert all(r["n"] == counts[r["id"] % 5, 900 + (r["id"] % 7) * 1.5] for r in got)
