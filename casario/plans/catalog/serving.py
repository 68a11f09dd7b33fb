"""Reading: segment, range, ranking, paging, bounds, map aggregates, locations, labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casario.functions import texts
from casario.operators import serve
from casario.plans.catalog import views
from casario.plans.catalog.registry import query
from casario.session import scratch_path
from casario.sources import locations


@query(
    "active_listings",
    f"""WITH {views.ACTIVE}
SELECT url, total_fee, bedrooms FROM listing l
WHERE business_type = 'O' AND listing_type = '2-HIGH' AND location_id = 'N3'
  AND url IN (SELECT url FROM active)""",
)
def active_listings(spark: SparkSession, folder: str) -> DataFrame:
    segment = serve.in_segment(views.listings(spark, folder), "O", "2-HIGH", "N3")
    return serve.active_listings(segment, views.active(spark, folder)).select("url", "total_fee", "bedrooms")


def priced_items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as priced listings: the catalogue price predicts the line price."""
    parts = views.table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand", "p_retailprice"
    )
    line = views.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return line.join(parts, "l_partkey").select(
        F.concat_ws("-", F.lit("/i/"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("url"),
        F.col("p_name").alias("title"),
        F.col("l_quantity").alias("usable_area"),
        F.col("p_type").alias("type_unit"),
        F.col("p_brand").alias("estacao"),
        (((F.col("l_orderkey") * 31) % 5003).cast("double") / F.lit(4.0)).alias("distance"),
        F.col("l_extendedprice").alias("total_fee"),
        (F.col("p_retailprice") * F.col("l_quantity")).alias("total_fee_predict"),
    )


PRICED = """priced AS (
  SELECT concat_ws('-', '/i/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS url, p_name AS title,
         l_quantity AS usable_area, p_type AS type_unit, p_brand AS estacao,
         CAST((l_orderkey * 31) % 5003 AS DOUBLE) / CAST(4 AS DOUBLE) AS distance,
         l_extendedprice AS total_fee, p_retailprice * l_quantity AS total_fee_predict
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_TABLE_ROW = """'[' || title || '](' || url || ')' AS title, usable_area, type_unit, estacao,
       round_even(distance, 0) AS distance, total_fee, round_even(total_fee_predict, 0) AS total_fee_predict"""


@query(
    "best_value_page",
    f"""WITH {PRICED}
SELECT {_TABLE_ROW}
FROM (SELECT *, total_fee - total_fee_predict AS error FROM priced
      WHERE total_fee BETWEEN 1000 AND 60000 AND usable_area BETWEEN 2 AND 40)
ORDER BY error ASC NULLS LAST, url LIMIT 25 OFFSET 25""",
)
def best_value_page(spark: SparkSession, folder: str) -> DataFrame:
    items = priced_items(spark, folder)
    chosen = items.where(F.col("total_fee").between(1000, 60000) & F.col("usable_area").between(2, 40))
    return serve.table_page(chosen, page=1)


@query(
    "sorted_page",
    f"""WITH {PRICED}
SELECT {_TABLE_ROW} FROM priced
ORDER BY estacao ASC NULLS LAST, round_even(distance, 0) DESC NULLS LAST, url LIMIT 40 OFFSET 120""",
)
def sorted_page(spark: SparkSession, folder: str) -> DataFrame:
    return serve.table_page(priced_items(spark, folder), page=3, size=40, sort_by=[("estacao", "asc"), ("distance", "desc")])


@query(
    "deep_page",
    f"""WITH {views.OFFERS}
SELECT url, total_fee, bedrooms FROM offers
ORDER BY bedrooms DESC NULLS LAST, total_fee ASC NULLS LAST, url LIMIT 25 OFFSET 10000""",
)
def deep_page(spark: SparkSession, folder: str) -> DataFrame:
    offers = views.offers(spark, folder).select("url", "total_fee", "bedrooms")
    path = scratch_path(spark, "order")
    serve.store_order(offers, path, sort_by=[("bedrooms", "desc"), ("total_fee", "asc")])
    return serve.stored_page(spark, path, page=400)


@query("page_count", "SELECT count(*) AS rows, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS pages FROM orders")
def page_count(spark: SparkSession, folder: str) -> DataFrame:
    return serve.page_count(views.offers(spark, folder))


@query(
    "range_filter",
    f"""WITH {views.OFFERS}
SELECT url, total_fee, bedrooms FROM offers
WHERE total_fee BETWEEN 100000 AND 250000 AND bedrooms BETWEEN 1 AND 3""",
)
def range_filter(spark: SparkSession, folder: str) -> DataFrame:
    offers = views.offers(spark, folder).select("url", "total_fee", "bedrooms")
    return serve.within(offers, (100000, 250000), (1, 3))


@query(
    "widget_bounds",
    """SELECT CAST(trunc(min(o_totalprice) / 500) AS BIGINT) * 500 AS total_fee_min,
       CAST(ceil(max(o_totalprice) / 500) AS BIGINT) * 500 AS total_fee_max FROM orders""",
)
def widget_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return serve.widget_bounds(views.offers(spark, folder), "total_fee", 500)


@query(
    "bedroom_bounds",
    """SELECT min(o_orderkey % 5) AS bedrooms_min, max(o_orderkey % 5) AS bedrooms_max FROM orders""",
)
def bedroom_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return serve.widget_bounds(views.offers(spark, folder), "bedrooms", 1)


@query(
    "filter_description",
    """SELECT 'Selecionado imóveis com valores entre [' || CAST(CAST(trunc(min(o_totalprice) / 500) AS BIGINT) * 500 AS VARCHAR)
  || ',' || CAST(CAST(ceil(max(o_totalprice) / 500) AS BIGINT) * 500 AS VARCHAR)
  || '] e que possuam a quantidade [' || CAST(min(o_orderkey % 5) AS VARCHAR) || ',' || CAST(max(o_orderkey % 5) AS VARCHAR)
  || '] de quartos' AS sentence FROM orders""",
)
def filter_description(spark: SparkSession, folder: str) -> DataFrame:
    from casario.functions.numbers import ceil_to_step, floor_to_step

    ends = views.offers(spark, folder).agg(
        F.min("total_fee").alias("p0"), F.max("total_fee").alias("p1"),
        F.min("bedrooms").alias("b0"), F.max("bedrooms").alias("b1"),
    )
    return ends.select(
        texts.filter_sentence(
            floor_to_step(F.col("p0"), 500), ceil_to_step(F.col("p1"), 500),
            floor_to_step(F.col("b0"), 1), ceil_to_step(F.col("b1"), 1),
        ).alias("sentence")
    )


@query("missing_geo", f"WITH {views.OFFERS} SELECT count(*) AS missing FROM offers WHERE address_lat IS NULL OR address_lon IS NULL")
def missing_geo(spark: SparkSession, folder: str) -> DataFrame:
    return serve.missing_places(views.offers(spark, folder))


@query(
    "centroid",
    f"""WITH {views.OFFERS}
SELECT round(avg(address_lat), 6) AS lat, round(avg(address_lon), 6) AS lon FROM offers
WHERE address_lat IS NOT NULL AND address_lon IS NOT NULL""",
)
def centroid(spark: SparkSession, folder: str) -> DataFrame:
    return serve.centroid(views.offers(spark, folder)).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_CLUSTER_SQL = f"""WITH {views.OFFERS}
SELECT {{level}}CAST(floor(address_lat / CAST(0.05 AS DOUBLE)) AS BIGINT) >> z AS cell_lat,
       CAST(floor(address_lon / CAST(0.05 AS DOUBLE)) AS BIGINT) >> z AS cell_lon,
       count(*) AS points, round(avg(address_lat), 6) AS lat, round(avg(address_lon), 6) AS lon, round(median(total_fee), 4) AS median_fee
FROM offers, (SELECT unnest({{levels}}) AS z) WHERE address_lat IS NOT NULL AND address_lon IS NOT NULL GROUP BY ALL"""


def _clusters(spark: SparkSession, folder: str, levels: int) -> DataFrame:
    found = serve.clusters(views.offers(spark, folder), levels=levels)
    return found.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6), "median_fee": F.round("median_fee", 4)})


@query("grid_clusters", _CLUSTER_SQL.format(level="", levels="[0]"))
def grid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder, 1).drop("level")


@query("cluster_levels", _CLUSTER_SQL.format(level="CAST(z AS INTEGER) AS level, ", levels="[0, 1, 2, 3, 4]"))
def cluster_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters of five zoom levels at once."""
    return _clusters(spark, folder, 5)


@query(
    "last_update",
    f"""WITH {views.ACTIVE}
SELECT business_type, listing_type, location_id, CAST(max(updated_date) AS VARCHAR) AS last_update
FROM active GROUP BY ALL""",
)
def last_update(spark: SparkSession, folder: str) -> DataFrame:
    found = serve.last_update(views.active(spark, folder))
    return found.withColumn("last_update", F.col("last_update").cast("string"))


AS_OF_DAY = dt.date(2001, 7, 20)


@query(
    "stale_segments",
    f"""WITH {views.ACTIVE}, requested AS (SELECT DISTINCT business_type, listing_type, location_id FROM listing)
SELECT r.business_type, r.listing_type, r.location_id, CAST(max(a.updated_date) AS VARCHAR) AS last_update
FROM requested r LEFT JOIN active a USING (business_type, listing_type, location_id)
GROUP BY ALL
HAVING max(a.updated_date) IS NULL OR CAST(max(a.updated_date) AS DATE) <> DATE '{AS_OF_DAY}'""",
)
def stale_segments(spark: SparkSession, folder: str) -> DataFrame:
    requested = views.listings(spark, folder).select(*serve.SEGMENT).distinct()
    found = serve.stale_segments(views.active(spark, folder), requested, AS_OF_DAY)
    return found.withColumn("last_update", F.col("last_update").cast("string"))


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as neighbourhoods of their region; every third one has no location id."""
    nations, regions = views.table(spark, folder, "nation"), views.table(spark, folder, "region")
    people = views.table(spark, folder, "customer")
    key = F.col("c_nationkey")
    path = F.concat(F.lit("BR>"), F.col("r_name"), F.lit(">NULL>"), F.col("r_name"), F.lit(">"), F.col("c_mktsegment"),
                    F.lit(">"), F.col("n_name"))
    return (
        people.join(nations, key == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("seq"),
            F.col("r_name").alias("city"),
            F.substring("r_name", 1, 2).alias("stateAcronym"),
            F.col("c_mktsegment").alias("zone"),
            F.when(F.col("c_custkey") % 7 != 0, path).alias("locationId"),
            F.col("c_name").alias("state"),
            F.concat(F.lit("Ção "), F.col("n_name")).alias("neighborhood"),
        )
    )


DIRECTORY = """directory AS (
  SELECT c_custkey AS seq, r_name AS city, substr(r_name, 1, 2) AS "stateAcronym", c_mktsegment AS zone,
         CASE WHEN c_custkey % 7 <> 0 THEN 'BR>' || r_name || '>NULL>' || r_name || '>' || c_mktsegment || '>' || n_name END AS "locationId",
         c_name AS state, 'Ção ' || n_name AS neighborhood
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_NAME_SQL = """split_part("locationId", '>', 6) || ', ' || split_part("locationId", '>', 4) || ' - ' || "stateAcronym\""""


_KEPT = ("city", '"stateAcronym"', "zone", '"locationId"', "state", "neighborhood")


def _named_sql(source: str) -> str:
    """Last entry per location id, placed where the id came first; then last placed id per name."""
    return f"""per_id AS (
  SELECT {_NAME_SQL} AS name, min(seq) AS place, "locationId", "stateAcronym",
         arg_max(city, seq) AS city, arg_max(zone, seq) AS zone, arg_max(state, seq) AS state,
         arg_max(neighborhood, seq) AS neighborhood
  FROM {source} WHERE "locationId" IS NOT NULL AND "locationId" <> '' GROUP BY "locationId", "stateAcronym")
SELECT name, {', '.join(f'arg_max({c}, place) AS {c}' for c in _KEPT)} FROM per_id GROUP BY name"""


@query(
    "location_search",
    f"""WITH {DIRECTORY}, hits AS (
  SELECT * FROM directory WHERE contains(lower(strip_accents(neighborhood)), 'cao nation_1') ORDER BY seq LIMIT 6),
{_named_sql('hits')}""",
)
def location_search(spark: SparkSession, folder: str) -> DataFrame:
    return locations.search_locations(directory(spark, folder), "ÇÃO nation_1").drop("place")


@query("location_directory", f"WITH {DIRECTORY}, {_named_sql('directory')}")
def location_directory(spark: SparkSession, folder: str) -> DataFrame:
    return locations.named_locations(directory(spark, folder)).drop("place")


def _money_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || 'R$ ' || translate(format('{{:,.2f}}', abs({x})), ',.', '.,'))"


@query("currency_text", f"SELECT c_custkey, {_money_sql('c_acctbal')} AS balance FROM customer")
def currency_text(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "customer").select("c_custkey", texts.currency(F.col("c_acctbal")).alias("balance"))


_PRICE, _CONDO = "o_totalprice", "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 2000 AS DOUBLE) END"


@query(
    "price_labels",
    f"""WITH priced AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'SALE' ELSE 'RENTAL' END AS kind, {_PRICE} AS price,
         coalesce({_CONDO}, 0) AS condo FROM orders)
SELECT o_orderkey, CASE kind WHEN 'SALE' THEN 'Compra' ELSE 'Aluguel' END AS kind_label,
  CASE WHEN kind = 'RENTAL' AND condo > 0 THEN
    'Valor ' || {_money_sql('price')} || '/Mês | Valor Condomínio ' || {_money_sql('condo')} || '/Mês | total ' || {_money_sql('(price + condo)')} || '/Mês'
  WHEN kind = 'RENTAL' THEN 'Valor ' || {_money_sql('price')} || '/Mês'
  ELSE 'Valor ' || {_money_sql('price')} || ' | Valor Condomínio ' || {_money_sql('condo')} || '/Mês | total ' || {_money_sql('price')} END AS label
FROM priced""",
)
def price_labels(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "O", "SALE").otherwise("RENTAL")
    condo = F.when(key % 3 == 1, F.lit(0.0)).when(key % 3 == 2, (key % 2000).cast("double"))
    priced = views.table(spark, folder, "orders").select(
        key, kind.alias("kind"), F.col("o_totalprice").alias("price"), condo.alias("condo")
    )
    total = F.col("price") + F.coalesce("condo", F.lit(0.0))
    return priced.select(
        key,
        texts.label_of(F.col("kind"), texts.BUSINESS_LABELS).alias("kind_label"),
        texts.price_label(F.col("kind"), F.col("price"), F.col("condo"), total).alias("label"),
    )
