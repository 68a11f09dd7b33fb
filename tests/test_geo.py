import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casario.functions import geo
from casario.operators.nearest import attach_nearest_station


def vincenty(lat1, lon1, lat2, lon2):
    """NumPy reference: inverse formula iterated far past convergence."""
    f, b = geo.FLATTENING, geo.MINOR_AXIS
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    diff = np.radians((np.asarray(lon2) - lon1 + 180) % 360 - 180)
    lam = diff + np.zeros(np.broadcast(lat1, lat2).shape)
    with np.errstate(all="ignore"):
        for _ in range(30):
            ss = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(ss == 0, 1, ss))
            ca = 1 - sa**2
            mid = np.where(ca == 0, 0, cs - 2 * np.sin(u1) * np.sin(u2) / np.where(ca == 0, 1, ca))
            c = f / 16 * ca * (4 + f * (4 - 3 * ca))
            lam = diff + (1 - c) * f * sa * (sigma + c * ss * (mid + c * cs * (2 * mid**2 - 1)))
    u = ca * (geo.MAJOR_AXIS**2 - b**2) / b**2
    big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    d = big_b * ss * (mid + big_b / 4 * (cs * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * ss**2 - 3) * (4 * mid**2 - 3)))
    return b * big_a * (sigma - d)


PAIRS = [
    (-22.9, -43.2, -22.9, -43.2),
    (0.0, 0.0, 0.0, 1.0),
    (0.0, 0.0, 1.0, 0.0),
    (50.0, 179.9, 50.0, -179.9),
    (-22.9068, -43.1729, -23.5505, -46.6333),
    (89.9, 10.0, 89.9, -170.0),
    (51.5, 0.0, -33.9, 151.2),
]


def test_distance_matches_numpy(spark):
    rng = random.Random(1)
    pairs = PAIRS + [(rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(-60, 60), rng.uniform(-180, 180)) for _ in range(200)]
    pairs = [p for p in pairs if vincenty(*p) < 1.8e7]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    rows = geo.with_geodesic(df, *ends, "flat").withColumn("nested", geo.geodesic(*ends)).orderBy("i").collect()
    for r, p in zip(rows, pairs):
        want = float(vincenty(*p))
        assert r["flat"] == pytest.approx(want, abs=1e-3), p
        assert r["nested"] == pytest.approx(want, abs=1e-3), p


def test_known_distance(spark):
    # one degree of longitude on the equator of the ellipsoid
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    got = geo.with_geodesic(df, *[F.col(c) for c in "abcd"], "m").first()["m"]
    assert got == pytest.approx(math.radians(1) * geo.MAJOR_AXIS, abs=1e-3)


def test_antipodes_fall_back_to_the_sphere(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.2, 179.9)], "a double, b double, c double, d double")
    row = geo.with_geodesic(df, *[F.col(c) for c in "abcd"], "m").first()
    assert row["m"] == pytest.approx(2.0e7, rel=0.01)


def _nearest(spark, points, sites, **options):
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "i int, address_lat double, address_lon double")
    s = spark.createDataFrame(
        [(i, "l", f"s{i}", *x) for i, x in enumerate(sites)], "station_id int, linha string, estacao string, lat double, lng double"
    )
    return attach_nearest_station(p, s, **options).orderBy("i").collect()


def _check(points, sites, rows):
    lat, lng = np.array(sites).T
    assert len(rows) == len(points)
    for r, (a, b) in zip(rows, points):
        if a is None or b is None:
            assert r["estacao"] is None and r["distance"] is None
            continue
        d = vincenty(a, b, lat, lng)
        assert r["distance"] == pytest.approx(d.min(), abs=1e-3)
        assert d[int(r["estacao"][1:])] == pytest.approx(d.min(), abs=1e-6)


def _cloud(rng, n, lat, lon, spread):
    return [(lat + rng.uniform(-spread, spread), lon + rng.uniform(-spread, spread)) for _ in range(n)]


def test_nearest_equals_brute_force_in_a_city(spark):
    rng = random.Random(2)
    points = _cloud(rng, 400, -22.9, -43.2, 0.3) + [(None, -43.0), (-22.9, None), (0.0, 0.0)]
    sites = _cloud(rng, 150, -22.9, -43.2, 0.3)
    sites += sites[:5]  # same coordinates: the lower station wins
    rows = _nearest(spark, points, sites)
    _check(points, sites, rows)
    assert all(int(r["estacao"][1:]) < 150 for r in rows if r["estacao"])


def test_nearest_equals_brute_force_around_the_globe(spark):
    rng = random.Random(3)
    points = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(150)]
    points += [(90.0, 0.0), (-90.0, 0.0), (10.0, 180.0), (10.0, -180.0), (0.0, 179.999)]
    sites = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(60)]
    _check(points, sites, _nearest(spark, points, sites))


def test_crowded_tile_is_split(spark):
    """Most stations and listings sit in one tile; the candidate lists stay short all the same."""
    rng = random.Random(4)
    points = _cloud(rng, 60, -22.9, -43.2, 0.002) + _cloud(rng, 20, -22.5, -43.0, 0.2)
    sites = _cloud(rng, 120, -22.9, -43.2, 0.002) + _cloud(rng, 20, -22.5, -43.0, 0.2)
    _check(points, sites, _nearest(spark, points, sites, dense=4))


def test_without_stations_everything_stays_null(spark):
    p = spark.createDataFrame([(1.0, 2.0)], "address_lat double, address_lon double")
    s = spark.createDataFrame([], "station_id int, linha string, estacao string, lat double, lng double")
    row = attach_nearest_station(p, s).first()
    assert row["estacao"] is None and row["distance"] is None


def test_no_pairwise_join(spark, folder):
    from casario.plans import catalog

    plan = catalog.queries()["nearest_station"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def by_quadrature(lat1, lon1, lat2, lon2):
    """Plain solution: the azimuth by halving, longitude and length as integrals by Gauss's rule instead of series."""
    f, b = geo.FLATTENING, geo.MINOR_AXIS
    nodes, weights = np.polynomial.legendre.leggauss(40)
    lam = abs(math.radians((lon2 - lon1 + 180) % 360 - 180))
    if abs(lat1) < abs(lat2):
        lat1, lat2 = lat2, lat1
    if lat1 > 0:
        lat1, lat2 = -lat1, -lat2
    b1, b2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))

    def travel(alpha):
        sin0 = math.sin(alpha) * math.cos(b1)
        x1 = math.cos(alpha) * math.cos(b1)
        x2 = math.sqrt(max(0.0, x1 * x1 + math.cos(b2) ** 2 - math.cos(b1) ** 2))
        s1, s2 = math.atan2(math.sin(b1) - 1e-300, x1), math.atan2(math.sin(b2), x2)
        k2 = (1 / (1 - f) ** 2 - 1) * (1 - sin0 * sin0)
        s = (s1 + s2) / 2 + (s2 - s1) / 2 * nodes
        root = np.sqrt(1 + k2 * np.sin(s) ** 2)
        turned = (s2 - s1) / 2 * np.sum(weights * (2 - f) / (1 + (1 - f) * root))
        omega = math.atan2(sin0 * math.sin(b2), x2) - math.atan2(sin0 * (math.sin(b1) - 1e-300), x1)
        return omega - f * sin0 * turned, b * (s2 - s1) / 2 * float(np.sum(weights * root))

    low, high = 0.0, math.pi
    for _ in range(70):
        mid = (low + high) / 2
        low, high = (mid, high) if travel(mid)[0] < lam else (low, mid)
    return travel((low + high) / 2)[1]


def test_nearly_antipodal_points(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        lat, lon = rng.uniform(-89.5, 89.5), rng.uniform(-180, 180)
        pairs.append((lat, lon, -lat + rng.uniform(-0.6, 0.6), lon + 180 + rng.uniform(-0.6, 0.6)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    rows = geo.with_geodesic(df, *ends, "flat").withColumn("nested", geo.geodesic(*ends)).orderBy("i").collect()
    for r, p in zip(rows, pairs):
        want = by_quadrature(*p)
        assert r["flat"] == pytest.approx(want, abs=1e-3), p
        assert r["nested"] == pytest.approx(want, abs=1e-3), p


def test_unknown_ends_have_no_distance(spark):
    df = spark.createDataFrame([(None, 0.0, 1.0, 2.0), (1.0, None, 1.0, 2.0), (1.0, 0.0, None, 2.0), (1.0, 0.0, 1.0, None)], "a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    for r in geo.with_geodesic(df, *ends, "flat").withColumn("nested", geo.geodesic(*ends)).collect():
        assert r["flat"] is None and r["nested"] is None
