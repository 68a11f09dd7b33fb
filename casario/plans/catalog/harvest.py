"""Links and headings out of the HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casario.plans.catalog import views
from casario.plans.catalog.registry import query
from casario.session import cut_lineage
from casario.sources import stations

_LINKS = """links AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS link FROM pages)"""


@query("link_harvest", f"WITH {_LINKS} SELECT url, link FROM links WHERE contains(link, 'the')")
def link_harvest(spark: SparkSession, folder: str) -> DataFrame:
    return stations.harvest_links(views.table(spark, folder, "pages"), containing="the")


def path_key(address):
    """First path segment of a link or page address, lower case, letters only."""
    path = F.regexp_replace(address, r"^https?://[^/]+", "")
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"^/([^/?#]*)", 1)), r"[.,;:!?]", "")


def _path_key_sql(address: str) -> str:
    path = f"regexp_replace({address}, '^https?://[^/]+', '')"
    return f"regexp_replace(lower(regexp_extract({path}, '^/([^/?#]*)', 1)), '[.,;:!?]', '', 'g')"


@query(
    "link_follow",
    f"""WITH {_LINKS}, keyed AS (SELECT DISTINCT url, {_path_key_sql('link')} AS key FROM links),
target AS (SELECT {_path_key_sql('url')} AS key, arg_min(url, page_id) AS url FROM pages GROUP BY 1),
hop1 AS (SELECT DISTINCT k.url AS seed, t.url AS via FROM keyed k JOIN target t USING (key)),
hop2 AS (SELECT DISTINCT h.seed, h.via, t.url AS reached FROM hop1 h JOIN keyed k ON k.url = h.via JOIN target t ON t.key = k.key)
SELECT seed, via, reached FROM hop2""",
)
def link_follow(spark: SparkSession, folder: str) -> DataFrame:
    """Two hops. Several pages share a path key: the one with the lowest id stands for it."""
    pages = views.table(spark, folder, "pages")
    links = stations.harvest_links(pages).select("url", path_key(F.col("link")).alias("key")).distinct()
    target = (
        pages.select(path_key(F.col("url")).alias("key"), "page_id", "url")
        .groupBy("key")
        .agg(F.min_by("url", "page_id").alias("target"))
    )
    # one row per (page, page it leads to); keys with no page are gone before the second hop
    step = links.join(target, "key").select("url", "target").distinct()
    first = step.select(F.col("url").alias("seed"), F.col("target").alias("via"))
    second = step.select(F.col("url").alias("via"), F.col("target").alias("reached"))
    return first.join(second, "via").select("seed", "via", "reached")


_DECODED = "replace(replace(replace({}, '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')"


@query(
    "station_directory",
    f"""SELECT url, {_DECODED.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS heading,
  {_DECODED.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title,
  CAST(len(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS INTEGER) AS links FROM pages""",
)
def station_directory(spark: SparkSession, folder: str) -> DataFrame:
    facts = stations.page_facts(views.table(spark, folder, "pages"))
    return facts.select("url", "heading", "title", F.size("links").alias("links"))


@query(
    "stations_of_state",
    f"""WITH {views.STATION}
SELECT 's' || CAST(station_id % 3 AS VARCHAR) AS uf, linha, estacao, round(lat, 6) AS lat, round(lng, 6) AS lng
FROM station WHERE station_id % 3 = 1 AND station_id % 11 <> 0""",
)
def stations_of_state(spark: SparkSession, folder: str) -> DataFrame:
    """Station table written by state, without the places that lack coordinates, and read for one state."""
    from casario.session import scratch_path
    from casario.sources.tables import Store

    key = F.col("station_id")
    rows = views.stations(spark, folder).select(
        "linha", "estacao", F.when(key % 11 != 0, F.col("lat")).alias("lat"), "lng",
        F.concat(F.lit("/s/"), key.cast("string")).alias("url"),
        F.concat(F.lit("s"), (key % 3).cast("string")).alias("uf"),
    )
    store = Store(spark, scratch_path(spark, "stations"))
    store.write_stations(rows)
    return store.stations("S1").select("uf", "linha", "estacao", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


BASE = "https://rail.example"


def rail_pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """An index page per nation, three lines each, a page per supplier as station, and its coordinates.

    Line pages also link a station in a paragraph and one below another element of a cell; neither is on the line.
    """
    key, line = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 3).cast("string")
    stops = views.stations(spark, folder).join(
        views.table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", F.col("s_suppkey").alias("station_id")), "station_id"
    ).select("*", F.concat_ws("_", F.col("s_nationkey").cast("string"), line).alias("on"))

    def page(url: Column, *body: Column) -> DataFrame:
        html = F.concat(F.lit("<html><body>"), *body, F.lit("</body></html>"))
        return stops.select(url.alias("url"), html.alias("html"))

    def gathered(by: str, url: Column, cell: Column, head: str, foot: Column) -> DataFrame:
        rows = stops.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(cell)), "").alias("cells"))
        return rows.select(url.alias("url"), F.concat(F.lit(f"<table>{head}"), "cells", F.lit("</table>"), foot).alias("html"))

    nation = F.col("s_nationkey").cast("string")
    line_cell = F.concat(F.lit('<tr><td><a title="line '), line, F.lit('" href="/line/'), "on", F.lit('">x</a></td><td>-</td></tr>'))
    stop_cell = F.concat(F.lit('<tr><td><a href="/wiki/Esta_'), key, F.lit('">stop</a></td></tr>'))
    decoys = F.lit('<p><a href="/wiki/Esta_1">near</a></p><table><tr><td><b><a href="/wiki/Esta_2">old</a></b></td></tr></table>')
    index = gathered("s_nationkey", F.concat(F.lit(f"{BASE}/index/"), nation), line_cell, "<tr><th>Terminais</th></tr>", F.lit(""))
    lines = gathered("on", F.concat(F.lit(f"{BASE}/line/"), "on"), stop_cell, "", decoys)
    station = page(
        F.concat(F.lit(f"{BASE}/wiki/Esta_"), key), F.lit('<h1 id="firstHeading">'), F.col("estacao"), F.lit("</h1>"),
        F.lit('<a href="https://tools.wmflabs.org/geo/'), key, F.lit('">map</a>'),
    )
    place = page(
        F.concat(F.lit("https://tools.wmflabs.org/geo/"), key), F.lit('<span class="geo"><span>'),
        F.when(F.col("s_suppkey") % 11 != 0, F.col("lat").cast("string")).otherwise("none"),
        F.lit("</span>, <span>"), F.col("lng").cast("string"), F.lit("</span></span>"),
    )
    seeds = stops.select(F.concat(F.lit("n"), nation).alias("uf"), F.concat(F.lit(f"{BASE}/index/"), nation).alias("url")).distinct()
    return index.union(lines).union(station).union(place), seeds


@query(
    "station_harvest",
    f"""WITH {views.STATION}
SELECT 'n' || CAST(s_nationkey AS VARCHAR) AS uf, 'line ' || CAST(s_suppkey % 3 AS VARCHAR) AS linha, estacao,
  '{BASE}/wiki/Esta_' || CAST(s_suppkey AS VARCHAR) AS url, round(lat, 6) AS lat, round(lng, 6) AS lng
FROM station JOIN supplier ON s_suppkey = station_id WHERE s_suppkey % 11 <> 0""",
)
def station_harvest(spark: SparkSession, folder: str) -> DataFrame:
    """Index, line, station and coordinate pages followed hop by hop; stations without coordinates are left out."""
    pages, seeds = rail_pages(spark, folder)
    found = stations.harvest_stations(cut_lineage(pages), cut_lineage(seeds), BASE)
    return found.select("uf", "linha", "estacao", "url", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))
