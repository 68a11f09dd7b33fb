"""Exact ellipsoidal distance of nearly antipodal points, as one column expression.

Vincenty's iteration does not converge there. The azimuth at the first point is found instead, by Newton's method on the
longitude that the geodesic reaches at the latitude of the second point (Karney, "Algorithms for geodesics", 2013). The points
are mirrored so that the first is the southern one of larger latitude; then that longitude grows with the azimuth,
which also brackets it: a step that leaves the bracket halves it.

The expression is interpreted: some 3 ms a row where it was measured (150,000 rows in 52 s on 8 cores). It is meant for the rare
rows that need it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 60
TINY = 1e-300

# Series in eps (rows: coefficients of eps^0, eps^1, ...) of the integrals of arc length and of reduced length, by multiples
# of twice the arc (fixed values, from the paper).
ARC = [
    [0, -1 / 2, 0, 3 / 16, 0, -1 / 32],
    [0, 0, -1 / 16, 0, 1 / 32, 0, -9 / 2048],
    [0, 0, 0, -1 / 48, 0, 3 / 256],
    [0, 0, 0, 0, -5 / 512, 0, 3 / 512],
    [0, 0, 0, 0, 0, -7 / 1280],
    [0, 0, 0, 0, 0, 0, -7 / 2048],
]
REDUCED = [
    [0, 1 / 2, 0, 1 / 16, 0, 1 / 32],
    [0, 0, 3 / 16, 0, 1 / 32, 0, 35 / 2048],
    [0, 0, 0, 5 / 48, 0, 5 / 256],
    [0, 0, 0, 0, 35 / 512, 0, 7 / 512],
    [0, 0, 0, 0, 0, 63 / 1280],
    [0, 0, 0, 0, 0, 0, 77 / 2048],
]
ARC_MEAN = [1, 0, 1 / 4, 0, 1 / 64, 0, 1 / 256]
REDUCED_MEAN = [1, 0, 1 / 4, 0, 9 / 64, 0, 25 / 256]


def longitude_series(n: float) -> tuple[list[float], list[list[float]]]:
    """The same for the integral of longitude, on an ellipsoid of third flattening ``n`` (fixed values, from the paper)."""
    mean = [1, -(1 - n) / 2, -(2 + n - 3 * n * n) / 8, -(1 + 3 * n + n * n) / 16, -(3 + 2 * n) / 64, -3 / 128]
    waves = [
        [0, (1 - n) / 4, (1 - n * n) / 8, (3 + 3 * n - n * n) / 64, (5 + 2 * n) / 128, 3 / 128],
        [0, 0, (2 - 3 * n + n * n) / 32, (3 - 2 * n - 3 * n * n) / 64, (3 + n) / 128, 5 / 256],
        [0, 0, 0, (5 - 9 * n + 5 * n * n) / 192, (9 - 10 * n) / 384, 7 / 512],
        [0, 0, 0, 0, (7 - 14 * n) / 512, 7 / 512],
        [0, 0, 0, 0, 0, 21 / 2560],
    ]
    return mean, waves


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct whose fields are evaluated once, inside array functions."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def _span(eps: Column, waves: list[list[float]], s1: Column, s2: Column) -> Column:
    """Integral over the arc from s1 to s2, over its mean."""
    out = s2 - s1
    for k, row in enumerate(waves, start=1):
        out = out + polynomial(eps, row) * (F.sin(s2 * (2 * k)) - F.sin(s1 * (2 * k)))
    return out


def _line(e: Column, azimuth: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the geodesic that leaves the first point at ``azimuth``: where it meets the second latitude."""

    def ends(d: Column) -> Column:
        # squares of cosines lose digits near the equator, squares of sines near the poles
        rise = F.when(e["cb1"] < -e["sb1"], (e["cb2"] - e["cb1"]) * (e["cb2"] + e["cb1"])).otherwise((e["sb1"] - e["sb2"]) * (e["sb1"] + e["sb2"]))
        out = F.sqrt(F.greatest(d["x1"] * d["x1"] + rise, F.lit(0.0)))
        return let(
            angles, sin0=d["sin0"], x1=d["x1"], x2=out,
            k2=F.lit(_SECOND) * (d["cos"] * d["cos"] + d["sin"] * d["sin"] * e["sb1"] * e["sb1"]),
        )

    def angles(d: Column) -> Column:
        return let(
            body, sin0=d["sin0"], x2=d["x2"], k2=d["k2"], s1=F.atan2(e["sb1"], d["x1"]), s2=F.atan2(e["sb2"], d["x2"]),
            omega=F.atan2(d["sin0"] * e["sb2"], d["x2"]) - F.atan2(d["sin0"] * e["sb1"], d["x1"]),
            eps=d["k2"] / (F.lit(2.0) * (F.lit(1.0) + F.sqrt(F.lit(1.0) + d["k2"])) + d["k2"]),
        )

    return let(
        ends, sin=F.sin(azimuth), cos=F.cos(azimuth), sin0=F.sin(azimuth) * e["cb1"], x1=F.cos(azimuth) * e["cb1"],
    )


def _ellipsoid(flattening: float) -> tuple[float, list[float], list[list[float]]]:
    n = flattening / (2 - flattening)
    mean, waves = longitude_series(n)
    return flattening * (2 - flattening) / (1 - flattening) ** 2, mean, waves


# WGS-84 (fixed values).
MAJOR_AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
_SECOND, _MEAN, _WAVES = _ellipsoid(FLATTENING)


def _reached(line: Column) -> Column:
    """Difference in longitude along the geodesic."""
    return line["omega"] - F.lit(FLATTENING) * line["sin0"] * polynomial(line["eps"], _MEAN) * _span(line["eps"], _WAVES, line["s1"], line["s2"])


def _arc_length(line: Column) -> Column:
    eps = line["eps"]
    return polynomial(eps, ARC_MEAN) / (F.lit(1.0) - eps) * _span(eps, ARC, line["s1"], line["s2"])


def _slope(line: Column) -> Column:
    """Derivative of :func:`_reached` by the azimuth: the reduced length over the way across the second parallel."""
    eps, s1, s2 = line["eps"], line["s1"], line["s2"]
    stretched = lambda s: F.sqrt(F.lit(1.0) + line["k2"] * F.sin(s) * F.sin(s))
    reduced = _arc_length(line) - polynomial(eps, REDUCED_MEAN) * (F.lit(1.0) - eps) * _span(eps, REDUCED, s1, s2)
    length = stretched(s2) * F.cos(s1) * F.sin(s2) - stretched(s1) * F.sin(s1) * F.cos(s2) - F.cos(s1) * F.cos(s2) * reduced
    return F.lit(1 - FLATTENING) * length / (line["x2"] + F.lit(TINY))


def _step(e: Column, state: Column) -> Column:
    """Newton from the azimuth of ``state``, inside its bracket."""

    def moved(v: Column) -> Column:
        low = F.when(v["off"] < 0, state["at"]).otherwise(state["low"])
        high = F.when(v["off"] < 0, state["high"]).otherwise(state["at"])

        def chosen(b: Column) -> Column:
            inside = (b["newton"] > b["low"]) & (b["newton"] < b["high"])
            at = F.when(inside, b["newton"]).otherwise((b["low"] + b["high"]) / 2)
            done = (F.abs(v["off"]) < 2e-15) | (b["high"] - b["low"] < 1e-15)
            return F.struct(b["low"].alias("low"), b["high"].alias("high"), F.when(done, state["at"]).otherwise(at).alias("at"), done.alias("done"))

        return let(chosen, low=low, high=high, newton=state["at"] - v["off"] / v["slope"])

    def measured(line: Column) -> Column:
        slope = _slope(line)
        return let(moved, off=_reached(line) - e["lam"], slope=F.when(F.abs(slope) > TINY, slope).otherwise(F.lit(TINY)))

    return F.when(state["done"], state).otherwise(_line(e, state["at"], measured))


def distance(sin_u1: Column, cos_u1: Column, sin_u2: Column, cos_u2: Column, diff: Column) -> Column:
    """Metres between points of given reduced latitudes and difference in longitude (radians, -pi to pi)."""

    def mirrored(d: Column) -> Column:
        swap = F.abs(d["s2"]) > F.abs(d["s1"])
        far, near = F.when(swap, d["s2"]).otherwise(d["s1"]), F.when(swap, d["s1"]).otherwise(d["s2"])
        return let(
            solved, sb1=-F.abs(far) - F.lit(TINY), cb1=F.when(swap, d["c2"]).otherwise(d["c1"]),
            sb2=F.when(far > 0, -near).otherwise(near), cb2=F.when(swap, d["c1"]).otherwise(d["c2"]), lam=F.abs(d["diff"]),
        )

    def solved(e: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi).alias("high"), F.lit(math.pi / 2).alias("at"), F.lit(False).alias("done"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda state, _: _step(e, state))
        metres = let(lambda a: _line(e, a["at"], lambda line: F.lit(MAJOR_AXIS * (1 - FLATTENING)) * _arc_length(line)), at=found["at"])
        # along the equator, as far as that is the shortest way
        on_equator = (e["sb1"] > -1e-290) & (e["lam"] <= (1 - FLATTENING) * math.pi)
        return F.when(on_equator, F.lit(MAJOR_AXIS) * e["lam"]).otherwise(metres)

    return let(mirrored, s1=sin_u1, c1=cos_u1, s2=sin_u2, c2=cos_u2, diff=diff)
