"""Listings, active set, stations and observations derived from the test tables.

Only column arithmetic, so the SQL text next to each view repeats it exactly. Numbers
that decide a row (17, 7919, ...) are arbitrary primes spreading the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _spread(key: Column, factor: int, modulus: int, start: float, width: float) -> Column:
    share = ((key * F.lit(factor)) % F.lit(modulus)).cast("double") / F.lit(float(modulus))
    return F.lit(start) + share * F.lit(width)


def _spread_sql(key: str, factor: int, modulus: int, start: float, width: float) -> str:
    return (
        f"(CAST({start} AS DOUBLE) + CAST(({key} * {factor}) % {modulus} AS DOUBLE)"
        f" / CAST({modulus} AS DOUBLE) * CAST({width} AS DOUBLE))"
    )


def listing_lat(key: Column) -> Column:
    return _spread(key, 7919, 10007, -23.0, 0.3)


def listing_lon(key: Column) -> Column:
    return _spread(key, 104729, 10009, -43.4, 0.4)


def station_lat(key: Column) -> Column:
    return _spread(key, 7907, 9973, -23.0, 0.3)


def station_lon(key: Column) -> Column:
    return _spread(key, 104723, 9967, -43.4, 0.4)


LISTING_LAT = _spread_sql("o_orderkey", 7919, 10007, -23.0, 0.3)
LISTING_LON = _spread_sql("o_orderkey", 104729, 10009, -43.4, 0.4)
STATION_LAT = _spread_sql("s_suppkey", 7907, 9973, -23.0, 0.3)
STATION_LON = _spread_sql("s_suppkey", 104723, 9967, -43.4, 0.4)


def offers(spark: SparkSession, folder: str) -> DataFrame:
    """Listings without neighbourhood and location: one per order, no join."""
    key = F.col("o_orderkey")
    placed = key % 17 != 0
    return table(spark, folder, "orders").select(
        F.concat(F.lit("/l/"), key.cast("string")).alias("url"),
        key.alias("o_orderkey"),
        F.col("o_custkey"),
        F.col("o_orderstatus").alias("business_type"),
        F.col("o_orderpriority").alias("listing_type"),
        F.col("o_totalprice").alias("total_fee"),
        (key % 5).cast("int").alias("bedrooms"),
        F.col("o_orderdate").cast("timestamp").alias("updated_date"),
        F.when(placed, listing_lat(key)).alias("address_lat"),
        F.when(placed, listing_lon(key)).alias("address_lon"),
    )


OFFERS = f"""offers AS (
  SELECT '/l/' || CAST(o_orderkey AS VARCHAR) AS url, o_orderkey, o_custkey,
         o_orderstatus AS business_type, o_orderpriority AS listing_type, o_totalprice AS total_fee,
         CAST(o_orderkey % 5 AS INTEGER) AS bedrooms, o_orderdate AS updated_date,
         CASE WHEN o_orderkey % 17 <> 0 THEN {LISTING_LAT} END AS address_lat,
         CASE WHEN o_orderkey % 17 <> 0 THEN {LISTING_LON} END AS address_lon
  FROM orders)"""


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Offers with the customer's market segment as neighbourhood and nation as location."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_mktsegment").alias("neighborhood"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("location_id"),
    )
    return offers(spark, folder).join(customers, "o_custkey")


LISTING = OFFERS + """, listing AS (
  SELECT f.*, c_mktsegment AS neighborhood, 'N' || CAST(c_nationkey AS VARCHAR) AS location_id
  FROM offers f JOIN customer ON o_custkey = c_custkey)"""


def active(spark: SparkSession, folder: str) -> DataFrame:
    """Two of three listings are active; activation lags the update by up to six days."""
    key = F.col("o_orderkey")
    return listings(spark, folder).where(key % 3 != 0).select(
        "url", "location_id", "business_type", "listing_type",
        (F.col("updated_date") + F.make_dt_interval((key % 7).cast("int"))).alias("updated_date"),
    )


ACTIVE = LISTING + """, active AS (
  SELECT url, location_id, business_type, listing_type,
         updated_date + to_days(CAST(o_orderkey % 7 AS INTEGER)) AS updated_date
  FROM listing WHERE o_orderkey % 3 <> 0)"""


def stations(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("station_id"),
        F.concat(F.lit("line "), (key % 12).cast("string")).alias("linha"),
        F.col("s_name").alias("estacao"),
        station_lat(key).alias("lat"),
        station_lon(key).alias("lng"),
    )


STATION = f"""station AS (
  SELECT s_suppkey AS station_id, 'line ' || CAST(s_suppkey % 12 AS VARCHAR) AS linha, s_name AS estacao,
         {STATION_LAT} AS lat, {STATION_LON} AS lng
  FROM supplier)"""


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as observed listing states: user_id is the key, event_id the order.

    Days go back and forth (event_id % 3 days are added) and some are missing.
    """
    key = F.col("event_id")
    moved = F.col("ts").cast("timestamp") + F.make_dt_interval((key % 3).cast("int"))
    return table(spark, folder, "events").select(
        "user_id", "event_id", "event_type", "value", "ts", F.when(key % 11 != 0, moved).alias("seen"),
    )


OBSERVATION = """observation AS (
  SELECT user_id, event_id, event_type, value, ts,
         CASE WHEN event_id % 11 <> 0 THEN ts + to_days(CAST(event_id % 3 AS INTEGER)) END AS seen
  FROM events)"""


def marked_sql(source: str, name: str = "marked") -> str:
    """Gate by the previous row of the key, spelled with a plain window."""
    return f"""before_{name} AS (
  SELECT *, row_number() OVER w AS rn, lag(seen) OVER w AS prev FROM {source}
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), {name} AS (
  SELECT *, (rn = 1 OR prev IS NULL OR seen IS NULL OR CAST(prev AS DATE) <> CAST(seen AS DATE)) AS applied
  FROM before_{name})"""
