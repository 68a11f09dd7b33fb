"""Distances and the nearest station."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casario.functions import geo
from casario.operators.nearest import attach_nearest_station
from casario.plans.catalog import views
from casario.plans.catalog.registry import query

_F = repr(geo.FLATTENING)
_B = repr(geo.MINOR_AXIS)
_RATIO = repr((geo.MAJOR_AXIS**2 - geo.MINOR_AXIS**2) / geo.MINOR_AXIS**2)


def geodesic_ctes(source: str, lat1: str, lon1: str, lat2: str, lon2: str, steps: int = geo.ITERATIONS) -> str:
    """CTEs from ``source`` to ``geodesic`` with a ``metres`` column: one CTE per iteration."""
    f, d = f"CAST({_F} AS DOUBLE)", "CAST({} AS DOUBLE)"
    out = [
        f"""g_u AS (SELECT *, atan((1 - {f}) * tan(radians({lat1}))) AS u1, atan((1 - {f}) * tan(radians({lat2}))) AS u2,
  radians(({lon2}) - ({lon1}) - 360 * floor((({lon2}) - ({lon1}) + 180) / 360)) AS diff FROM {source})""",
        "g_0 AS (SELECT *, diff AS lam FROM g_u)",
    ]
    angle = """sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
  sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs"""
    for i in range(steps + 1):
        out.append(f"g_a{i} AS (SELECT *, {angle} FROM g_{i})")
        out.append(f"g_b{i} AS (SELECT *, coalesce(cos(u1) * cos(u2) * sin(lam) / nullif(ss, 0), 0) AS sa FROM g_a{i})")
        out.append(
            f"g_c{i} AS (SELECT *, 1 - sa * sa AS ca, coalesce(cs - 2 * sin(u1) * sin(u2) / nullif(1 - sa * sa, 0), 0) AS mid FROM g_b{i})"
        )
        if i < steps:
            out.append(
                f"""g_d{i} AS (SELECT *, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS cc FROM g_c{i}),
g_{i + 1} AS (SELECT * EXCLUDE (lam, ss, cs, sa, ca, mid, cc),
  diff + (1 - cc) * {f} * sa * (atan2(ss, cs) + cc * ss * (mid + cc * cs * (2 * mid * mid - 1))) AS lam FROM g_d{i})"""
            )
    b, ratio = d.format(_B), d.format(_RATIO)
    out.append(
        f"""g_e AS (SELECT *, 1 + ca * {ratio} / 16384 * (4096 + ca * {ratio} * (-768 + ca * {ratio} * (320 - 175 * ca * {ratio}))) AS ba,
  ca * {ratio} / 1024 * (256 + ca * {ratio} * (-128 + ca * {ratio} * (74 - 47 * ca * {ratio}))) AS bb FROM g_c{steps}),
geodesic AS (SELECT *, {b} * ba * (atan2(ss, cs) - bb * ss * (mid + bb / 4 * (cs * (2 * mid * mid - 1)
  - bb / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))) AS metres FROM g_e)"""
    )
    return ",\n".join(out)


_HAVERSINE = f"""{2 * geo.MEAN_RADIUS} * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2)
  + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"""

_PLACE = {
    "lat1": views.LISTING_LAT.replace("o_orderkey", "l_orderkey"),
    "lon1": views.LISTING_LON.replace("o_orderkey", "l_orderkey"),
    "lat2": views.STATION_LAT.replace("s_suppkey", "l_suppkey"),
    "lon2": views.STATION_LON.replace("s_suppkey", "l_suppkey"),
}


@query(
    "geodesic_distance",
    f"""WITH pairs AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {n}' for n, e in _PLACE.items())} FROM lineitem),
{geodesic_ctes('pairs', 'lat1', 'lon1', 'lat2', 'lon2')}
SELECT l_orderkey, l_linenumber, round(metres, 2) AS metres, round({_HAVERSINE}, 2) AS sphere_metres FROM geodesic""",
)
def geodesic_distance(spark: SparkSession, folder: str) -> DataFrame:
    pairs = views.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        views.listing_lat(F.col("l_orderkey")).alias("lat1"), views.listing_lon(F.col("l_orderkey")).alias("lon1"),
        views.station_lat(F.col("l_suppkey")).alias("lat2"), views.station_lon(F.col("l_suppkey")).alias("lon2"),
    )
    ends = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    measured = geo.with_geodesic(pairs, *ends, "metres")
    return measured.select(
        "l_orderkey", "l_linenumber", F.round("metres", 2).alias("metres"),
        F.round(geo.haversine(*ends), 2).alias("sphere_metres"),
    )


@query(
    "nearest_station",
    f"""WITH {views.OFFERS}, {views.STATION},
pairs AS (SELECT url, address_lat, address_lon, station_id, linha, estacao, lat, lng FROM offers, station WHERE address_lat IS NOT NULL),
{geodesic_ctes('pairs', 'address_lat', 'address_lon', 'lat', 'lng')},
ranked AS (SELECT url, linha, estacao, lat, lng, metres,
  row_number() OVER (PARTITION BY url ORDER BY metres, station_id) AS rn FROM geodesic)
SELECT o.url, r.linha, r.estacao, round(r.lat, 6) AS lat_metro, round(r.lng, 6) AS lon_metro, round(r.metres, 2) AS distance
FROM offers o LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON o.url = r.url""",
)
def nearest_station(spark: SparkSession, folder: str) -> DataFrame:
    offers = views.offers(spark, folder).select("url", "address_lat", "address_lon")
    found = attach_nearest_station(offers, views.stations(spark, folder))
    return found.select(
        "url", "linha", "estacao", F.round("lat_metro", 6).alias("lat_metro"),
        F.round("lon_metro", 6).alias("lon_metro"), F.round("distance", 2).alias("distance"),
    )


# Nearly antipodal pairs with published distances on WGS-84, in millimetres exact (fixed values).
ANTIPODAL = [
    (0.0, 0.0, 0.5, 179.5, 19936288.579),
    (88.202499451857, 0.0, -88.202499451857, 179.981022032992859592, 20003898.214),
    (89.262080389218, 0.0, -89.262080389218, 179.992207982775375662, 20003925.854),
    (89.333123580033, 0.0, -89.333123580032997687, 179.99295812360148422, 20003926.881),
    (56.320923501171, 0.0, -56.320923501171, 179.664747671772880215, 19993558.287),
    (52.784459512564, 0.0, -52.784459512563990912, 179.634407464943777557, 19991596.095),
    (48.522876735459, 0.0, -48.52287673545898293, 179.599720456223079643, 19989144.774),
    (0.0, 0.0, 0.0, 180.0, 20003931.459),
    (0.0, 0.0, 1.0, 180.0, 19893357.070),
]


@query(
    "antipodal_distance",
    f"""WITH known(pair, metres) AS (VALUES {', '.join(f'({i}, {p[4]:.3f})' for i, p in enumerate(ANTIPODAL))})
SELECT c_custkey, CAST(c_custkey % {len(ANTIPODAL)} AS INTEGER) AS pair, CAST(metres AS DOUBLE) AS metres
FROM customer JOIN known ON pair = c_custkey % {len(ANTIPODAL)}""",
)
def antipodal_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Known pairs, turned to the meridian of each row, with ends swapped and hemispheres mirrored: their distances stay."""
    pair = (F.col("c_custkey") % len(ANTIPODAL)).cast("int")
    lat1, lon1, lat2, lon2 = (F.get(F.array(*[F.lit(p[k]) for p in ANTIPODAL]), F.col("pair")) for k in range(4))
    turn = ((F.col("c_custkey") * 7) % 720).cast("double") / F.lit(2.0) - F.lit(180.0)
    north = F.when(F.col("c_custkey") % 3 == 0, 1.0).otherwise(-1.0)
    customers = views.table(spark, folder, "customer").select("c_custkey")
    # a scan of few files would solve on few cores
    placed = customers.repartition("c_custkey").withColumn("pair", pair).select(
        "c_custkey", "pair", (F.col("c_custkey") % 4 < 2).alias("swap"),
        (lat1 * north).alias("a"), (lon1 + turn).alias("b"), (lat2 * north).alias("c"), (lon2 + turn).alias("d"),
    )
    first = [F.when(F.col("swap"), F.col(x)).otherwise(F.col(y)) for x, y in (("c", "a"), ("d", "b"))]
    second = [F.when(F.col("swap"), F.col(x)).otherwise(F.col(y)) for x, y in (("a", "c"), ("b", "d"))]
    return geo.with_geodesic(placed, *first, *second, "metres").select(
        "c_custkey", "pair", F.round("metres", 3).alias("metres")
    )
