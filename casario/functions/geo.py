"""Distances on the WGS-84 ellipsoid as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casario.functions import antipodal
from casario.functions.antipodal import FLATTENING, MAJOR_AXIS

# WGS-84 and the mean earth radius (fixed values).
MINOR_AXIS = MAJOR_AXIS * (1 - FLATTENING)
MEAN_RADIUS = 6371008.8

# Curvature radii of the ellipsoid lie in 6,335.4 .. 6,399.6 km; widened by 10 km each way.
RADIUS_LOW = 6325000.0
RADIUS_HIGH = 6410000.0

# each iteration divides the error by about 300
ITERATIONS = 5
TINY = 1e-300


def _at_most_one(value: Column) -> Column:
    # not least(): that skips nulls
    return F.when(value > 1, F.lit(1.0)).otherwise(value)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on the mean sphere."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * MEAN_RADIUS) * F.asin(F.sqrt(_at_most_one(h)))


def cartesian(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of a point on the ellipsoid."""
    e2 = FLATTENING * (2 - FLATTENING)
    phi, theta = F.radians(lat), F.radians(lon)
    normal = F.lit(MAJOR_AXIS) / F.sqrt(F.lit(1.0) - F.lit(e2) * F.sin(phi) * F.sin(phi))
    return (
        normal * F.cos(phi) * F.cos(theta),
        normal * F.cos(phi) * F.sin(theta),
        normal * F.lit(1 - e2) * F.sin(phi),
    )


def chord_limit(nearest: Column) -> Column:
    """Longest chord whose geodesic can still be as short as that of chord ``nearest``.

    A surface curve of curvature between 1/RADIUS_HIGH and 1/RADIUS_LOW and chord c is
    between 2R*asin(c/2R) of the two radii long, so ordering by chord is exact up to
    this (very thin) margin.
    """
    half_angle = F.asin(_at_most_one(nearest / F.lit(2 * RADIUS_LOW)))
    reach = F.lit(2 * RADIUS_HIGH) * F.sin(half_angle * F.lit(RADIUS_LOW / RADIUS_HIGH))
    return F.when(half_angle > F.lit(1.5), F.lit(2 * RADIUS_HIGH)).otherwise(reach * F.lit(1 + 1e-9) + F.lit(1e-6))


@dataclass
class _Ends:
    """Reduced latitudes of both ends and their difference in longitude."""

    sin_u1: Column
    cos_u1: Column
    sin_u2: Column
    cos_u2: Column
    diff: Column


def _ends(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> _Ends:
    u1 = F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat1)))
    u2 = F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat2)))
    raw = lon2 - lon1
    wrapped = raw - F.lit(360.0) * F.floor((raw + F.lit(180.0)) / F.lit(360.0))
    return _Ends(F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2), F.radians(wrapped))


def _arc(e: _Ends, lam: Column) -> tuple[Column, Column]:
    """sin and cos of the angular distance for longitude difference ``lam``."""
    across = e.cos_u2 * F.sin(lam)
    along = e.cos_u1 * e.sin_u2 - e.sin_u1 * e.cos_u2 * F.cos(lam)
    return F.sqrt(across * across + along * along), e.sin_u1 * e.sin_u2 + e.cos_u1 * e.cos_u2 * F.cos(lam)


def _azimuth(e: _Ends, lam: Column, sin_s: Column) -> Column:
    """sin(alpha) at the equator crossing.

    Where the divisor is zero so is the dividend; TINY keeps the quotient at zero without
    a branch, which lets generated code share the common parts. The same goes for _mid.
    """
    return e.cos_u1 * e.cos_u2 * F.sin(lam) / (sin_s + F.lit(TINY))


def _mid(e: _Ends, cos_s: Column, cos2_a: Column) -> Column:
    """cos(2 sigma_m)."""
    return cos_s - F.lit(2.0) * e.sin_u1 * e.sin_u2 / (cos2_a + F.lit(TINY))


def _next_lambda(e: _Ends, sin_s: Column, cos_s: Column, sin_a: Column) -> Column:
    f = FLATTENING
    cos2_a = F.lit(1.0) - sin_a * sin_a
    mid = _mid(e, cos_s, cos2_a)
    c = F.lit(f / 16) * cos2_a * (F.lit(4.0) + F.lit(f) * (F.lit(4.0) - F.lit(3.0) * cos2_a))
    sigma = F.atan2(sin_s, cos_s)
    inner = mid + c * cos_s * (F.lit(2.0) * mid * mid - F.lit(1.0))
    return e.diff + (F.lit(1.0) - c) * F.lit(f) * sin_a * (sigma + c * sin_s * inner)


def _metres(sin_s: Column, cos_s: Column, cos2_a: Column, mid: Column) -> Column:
    ratio = (MAJOR_AXIS**2 - MINOR_AXIS**2) / MINOR_AXIS**2
    u2 = cos2_a * F.lit(ratio)
    big_a = F.lit(1.0) + u2 / 16384 * (F.lit(4096.0) + u2 * (F.lit(-768.0) + u2 * (F.lit(320.0) - F.lit(175.0) * u2)))
    big_b = u2 / 1024 * (F.lit(256.0) + u2 * (F.lit(-128.0) + u2 * (F.lit(74.0) - F.lit(47.0) * u2)))
    mid2 = mid * mid
    delta = (
        big_b
        * sin_s
        * (
            mid
            + big_b
            / 4
            * (
                cos_s * (F.lit(2.0) * mid2 - F.lit(1.0))
                - big_b / 6 * mid * (F.lit(4.0) * sin_s * sin_s - F.lit(3.0)) * (F.lit(4.0) * mid2 - F.lit(3.0))
            )
        )
    )
    return F.lit(MINOR_AXIS) * big_a * (F.atan2(sin_s, cos_s) - delta)


def with_geodesic(
    df: DataFrame, lat1: Column, lon1: Column, lat2: Column, lon2: Column, name: str, steps: int = ITERATIONS
) -> DataFrame:
    """Adds the ellipsoidal distance in metres (Vincenty's inverse formula).

    Each iteration is its own projection, so intermediate values are computed once.
    Pairs that do not converge (nearly antipodal) are solved for the azimuth instead, in a
    projection of their own, so that all others stay in generated code.
    """
    e = _ends(lat1, lon1, lat2, lon2)
    parts = {"_g_su1": e.sin_u1, "_g_cu1": e.cos_u1, "_g_su2": e.sin_u2, "_g_cu2": e.cos_u2, "_g_diff": e.diff}
    out = df.withColumns({**parts, "_g_lam": e.diff})
    e = _Ends(*[F.col(c) for c in parts])
    lam, ss, cs, sa = F.col("_g_lam"), F.col("_g_ss"), F.col("_g_cs"), F.col("_g_sa")

    def arcs(df: DataFrame) -> DataFrame:
        sin_s, cos_s = _arc(e, lam)
        return df.withColumns({"_g_ss": sin_s, "_g_cs": cos_s, "_g_sa": _azimuth(e, lam, sin_s)})

    for _ in range(steps):
        out = arcs(out).withColumns({"_g_prev": lam, "_g_lam": _next_lambda(e, ss, cs, sa)})
    out = arcs(out)
    settled = (F.abs(lam - F.col("_g_prev")) < 1e-9) & (F.abs(lam) <= math.pi)
    cos2_a = F.lit(1.0) - sa * sa
    out = out.withColumn("_g_m", F.when(settled, _metres(ss, cs, cos2_a, _mid(e, cs, cos2_a))))
    solved = antipodal.distance(e.sin_u1, e.cos_u1, e.sin_u2, e.cos_u2, e.diff)
    # the value is named twice, which keeps the projections apart
    distance = F.when(F.col("_g_m").isNotNull(), F.col("_g_m")).when(e.diff.isNotNull() & e.sin_u1.isNotNull() & e.sin_u2.isNotNull(), solved)
    return out.withColumn(name, distance).drop(*parts, "_g_lam", "_g_prev", "_g_ss", "_g_cs", "_g_sa", "_g_m")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, inside array functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column, steps: int = ITERATIONS) -> Column:
    """The same distance as one expression, for use inside array functions.

    Interpreted rather than generated code: meant for the rare rows that need it.
    """
    names = ("sin_u1", "cos_u1", "sin_u2", "cos_u2", "diff")

    def measured(ends: Column) -> Column:
        e = _Ends(*[ends[n] for n in names])

        def arc(lam: Column, body) -> Column:
            sin_s, cos_s = _arc(e, lam)
            return _let(
                F.struct(sin_s.alias("ss"), cos_s.alias("cs")),
                lambda a: _let(_azimuth(e, lam, a["ss"]), lambda sa: body(a["ss"], a["cs"], sa)),
            )

        def step(acc: Column, _: Column) -> Column:
            lam = acc["lam"]
            following = arc(lam, lambda ss, cs, sa: _next_lambda(e, ss, cs, sa))
            return F.struct(following.alias("lam"), lam.alias("prev"))

        def finish(acc: Column) -> Column:
            lam = acc["lam"]
            settled = (F.abs(lam - acc["prev"]) < 1e-9) & (F.abs(lam) <= math.pi)

            def metres(ss: Column, cs: Column, sa: Column) -> Column:
                return _let(F.lit(1.0) - sa * sa, lambda ca: _let(_mid(e, cs, ca), lambda mid: _metres(ss, cs, ca, mid)))

            solved = antipodal.distance(e.sin_u1, e.cos_u1, e.sin_u2, e.cos_u2, e.diff)
            return F.when(settled, arc(lam, metres)).when(lam.isNotNull(), solved)

        start = F.struct(e.diff.alias("lam"), e.diff.alias("prev"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, finish)

    e = _ends(lat1, lon1, lat2, lon2)
    return _let(F.struct(*[getattr(e, n).alias(n) for n in names]), measured)
