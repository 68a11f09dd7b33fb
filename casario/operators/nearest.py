"""Nearest station per listing (exact, by ellipsoidal distance) without a pairwise join.

Stations are narrowed top-down over a grid of tiles: a tile inherits the candidates of
its parent tile and keeps those that can be nearest to some point in it. Work is
proportional to tiles plus stations, never listings times stations. Listings then meet
one candidate list per tile in an equi-join that keeps one row per listing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casario.functions import geo
from casario.session import cut_lineage

# Tile levels: at level L the globe is cut into 2^L columns of 360/2^L degrees.
LEVELS = (3, 7, 11, 15)
# Finer levels, visited only for tiles that keep more than DENSE candidates.
DEEP_LEVELS = (18, 21, 24, 27)
DENSE = 32
# A level up to this one has at most 2^9 * 2^8 tiles, which is always small enough to broadcast.
BROADCAST_LEVEL = 9

_TILE = ["ix", "iy"]


def _tile_of(lat: Column, lon: Column, level: int | Column) -> dict[str, Column]:
    """Tile indices; longitudes wrap around and the north pole belongs to the top row."""
    cells = F.lit(float(2**level)) if isinstance(level, int) else F.pow(F.lit(2.0), level)
    turns = (lon + F.lit(180.0)) / F.lit(360.0)
    row = F.floor((lat + F.lit(90.0)) / F.lit(360.0) * cells)
    top = cells / F.lit(2.0) - F.lit(1.0)
    return {
        "ix": F.floor((turns - F.floor(turns)) * cells).cast("bigint"),
        "iy": F.when(row > top, top).otherwise(row).cast("bigint"),
    }


def _bounded(df: DataFrame, level: int) -> DataFrame:
    return F.broadcast(df) if level <= BROADCAST_LEVEL else df


def _prune(pairs: DataFrame, level: int) -> DataFrame:
    """Keep, per tile, the stations that can be nearest to some point of the tile."""
    size = 360.0 / 2**level
    lat = (F.col("iy") + F.lit(0.5)) * F.lit(size) - F.lit(90.0)
    lon = (F.col("ix") + F.lit(0.5)) * F.lit(size) - F.lit(180.0)
    x, y, z = geo.cartesian(F.col("_clat"), F.col("_clon"))
    half = math.radians(size / 2)
    # longest chord from the centre: the meridian part and the part across at the widest parallel
    inner_lat = F.greatest(F.lit(0.0), F.abs(F.col("_clat")) - F.lit(size / 2))
    across = F.cos(F.radians(inner_lat))
    reach = F.lit(geo.RADIUS_HIGH * half) * F.sqrt(F.lit(1.0) + across * across)
    # read twice below; without the cut the plan would double at every level
    scored = cut_lineage(
        pairs.withColumns({"_clat": lat, "_clon": lon})
        .withColumns({"_cx": x, "_cy": y, "_cz": z, "_reach": reach})
        .withColumn(
            "_chord",
            F.sqrt(
                (F.col("x") - F.col("_cx")) * (F.col("x") - F.col("_cx"))
                + (F.col("y") - F.col("_cy")) * (F.col("y") - F.col("_cy"))
                + (F.col("z") - F.col("_cz")) * (F.col("z") - F.col("_cz"))
            ),
        )
        .select(*_TILE, "si", "x", "y", "z", "_chord", "_reach")
    )
    bound = (
        scored.groupBy(*_TILE)
        .agg(F.min("_chord").alias("_near"), F.max("_reach").alias("_r"))
        .select(*_TILE, (geo.chord_limit(F.col("_near") + F.col("_r")) + F.col("_r")).alias("_limit"))
    )
    return (
        scored.join(_bounded(bound, level), _TILE)
        .where(F.col("_chord") <= F.col("_limit"))
        .select(*_TILE, "si", "x", "y", "z")
    )


def _refine(pairs: DataFrame, parent: int, tiles: DataFrame, level: int) -> DataFrame:
    """Hand the candidates of each tile at ``parent`` to its occupied tiles at ``level``."""
    shift = level - parent
    children = tiles.select(
        *_TILE, F.shiftright("ix", shift).alias("_pix"), F.shiftright("iy", shift).alias("_piy")
    )
    handed = (
        pairs.withColumnsRenamed({"ix": "_pix", "iy": "_piy"})
        .join(_bounded(children, level), ["_pix", "_piy"])
        .select(*_TILE, "si", "x", "y", "z")
    )
    return _prune(handed, level)


def _occupied(points: DataFrame, level: int) -> DataFrame:
    return points.select(
        *[c.alias(n) for n, c in _tile_of(F.col("_lat"), F.col("_lon"), level).items()]
    ).distinct()


def _coarsen(tiles: DataFrame, shift: int) -> DataFrame:
    return tiles.select(F.shiftright("ix", shift).alias("ix"), F.shiftright("iy", shift).alias("iy")).distinct()


def tile_candidates(points: DataFrame, sites: DataFrame, dense: int = DENSE) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """Candidate stations per tile.

    Returns ``(level, ix, iy, si)`` rows and, for each level that had tiles with more
    than ``dense`` candidates, those tiles (their listings use the next finer level).
    """
    leaf_level = LEVELS[-1]
    leaf = cut_lineage(_occupied(points, leaf_level))
    first = LEVELS[0]
    coarse = _coarsen(leaf, leaf_level - first)
    columns, rows = 2**first, 2 ** (first - 1)
    # every station against the fixed set of coarsest tiles, then only the occupied ones
    everywhere = sites.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(columns * rows - 1)))).select(
        (F.col("_t") % columns).cast("bigint").alias("ix"),
        F.floor(F.col("_t") / columns).cast("bigint").alias("iy"),
        "si", "x", "y", "z",
    )
    pairs = _prune(everywhere.join(F.broadcast(coarse), _TILE, "left_semi"), first)
    for parent, level in zip(LEVELS, LEVELS[1:]):
        tiles = leaf if level == leaf_level else _coarsen(leaf, leaf_level - level)
        pairs = _refine(pairs, parent, tiles, level)
    found, split = [], []
    level = leaf_level
    for deeper in (*DEEP_LEVELS, None):
        crowded = pairs.groupBy(*_TILE).count().where(F.col("count") > dense).select(*_TILE)
        if deeper is None or crowded.isEmpty():
            found.append(pairs.select(F.lit(level).alias("level"), *_TILE, "si"))
            break
        crowded = cut_lineage(crowded)
        found.append(pairs.join(crowded, _TILE, "left_anti").select(F.lit(level).alias("level"), *_TILE, "si"))
        split.append((level, crowded))
        # all occupied finer tiles below the crowded ones
        tiles = (
            _occupied(points, deeper)
            .withColumns({"_pix": F.shiftright("ix", deeper - level), "_piy": F.shiftright("iy", deeper - level)})
            .join(crowded.withColumnsRenamed({"ix": "_pix", "iy": "_piy"}), ["_pix", "_piy"], "left_semi")
            .select(*_TILE)
        )
        pairs = _refine(pairs.join(crowded, _TILE, "left_semi"), level, tiles, deeper)
        level = deeper
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out, split


def attach_nearest_station(
    listings: DataFrame,
    stations: DataFrame,
    lat: str = "address_lat",
    lon: str = "address_lon",
    order: str = "station_id",
    dense: int = DENSE,
) -> DataFrame:
    """Adds linha, estacao, lat_metro, lon_metro and distance (metres) to every listing.

    ``order`` names a unique station column that breaks ties. Listings without
    coordinates keep nulls, as all do when there is no station.
    """
    # one station per coordinate is enough, the lowest by `order`
    sites = (
        stations.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .groupBy("lat", "lng")
        .agg(F.min(F.struct(F.col(order).alias("si"), "linha", "estacao")).alias("s"))
        .select("s.*", "lat", "lng", *[c.alias(n) for c, n in zip(geo.cartesian(F.col("lat"), F.col("lng")), "xyz")])
    )
    points = listings.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(lat).alias("_lat"), F.col(lon).alias("_lon")
    )
    found, split = tile_candidates(points, sites.select("si", "x", "y", "z"), dense)
    # written out so that its size decides how the listings are joined to it
    lists = cut_lineage(
        found.join(sites, "si")
        .groupBy("level", *_TILE)
        .agg(F.collect_list(F.struct("si", "lat", "lng", "x", "y", "z", "linha", "estacao")).alias("_near"))
    )
    px, py, pz = geo.cartesian(F.col(lat), F.col(lon))
    keyed = listings.withColumns({"_px": px, "_py": py, "_pz": pz, "_level": F.lit(LEVELS[-1])})
    for (level, crowded), deeper in zip(split, DEEP_LEVELS):
        marks = crowded.select(F.col("ix").alias("_mx"), F.col("iy").alias("_my"), F.lit(True).alias("_deeper"))
        keyed = (
            keyed.withColumns({f"_m{n[1]}": c for n, c in _tile_of(F.col(lat), F.col(lon), level).items()})
            .join(marks, ["_mx", "_my"], "left")
            .withColumn("_level", F.when(F.col("_deeper"), F.lit(deeper)).otherwise(F.col("_level")))
            .drop("_mx", "_my", "_deeper")
        )
    keyed = keyed.withColumns({f"_{n}": c for n, c in _tile_of(F.col(lat), F.col(lon), F.col("_level")).items()})
    lists = lists.withColumnsRenamed({"level": "_level", "ix": "_ix", "iy": "_iy"})
    joined = keyed.join(lists, ["_level", "_ix", "_iy"], "left")

    def chord2(s: Column) -> Column:
        return (
            (s["x"] - F.col("_px")) * (s["x"] - F.col("_px"))
            + (s["y"] - F.col("_py")) * (s["y"] - F.col("_py"))
            + (s["z"] - F.col("_pz")) * (s["z"] - F.col("_pz"))
        )

    def measured(s: Column, c2: Column) -> Column:
        d = geo.geodesic(F.col(lat), F.col(lon), s["lat"], s["lng"])
        return F.when(c2 <= F.col("_limit"), F.struct(d.alias("d"), s["si"].alias("si"), s.alias("s")))

    ranked = joined.withColumn("_c2", F.transform("_near", chord2)).withColumn("_best", F.array_min("_c2"))
    reach = geo.chord_limit(F.sqrt(F.col("_best")))
    ranked = ranked.withColumn("_limit", reach * reach)
    # almost always one station is within the limit; only otherwise are distances compared
    rivals = F.size(F.filter("_c2", lambda c: c <= F.col("_limit")))
    chosen = ranked.withColumn(
        "_s",
        F.when(rivals > 1, F.array_min(F.zip_with("_near", "_c2", measured))["s"]).otherwise(
            F.get("_near", (F.array_position("_c2", F.col("_best")) - 1).cast("int"))
        ),
    ).select(*listings.columns, "_s")
    chosen = chosen.withColumns(
        {
            "linha": F.col("_s.linha"),
            "estacao": F.col("_s.estacao"),
            "lat_metro": F.col("_s.lat"),
            "lon_metro": F.col("_s.lng"),
        }
    ).drop("_s")
    return geo.with_geodesic(chosen, F.col(lat), F.col(lon), F.col("lat_metro"), F.col("lon_metro"), "distance")
