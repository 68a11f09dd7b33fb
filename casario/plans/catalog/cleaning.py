"""Page documents, record cleaning and raw JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casario.functions import numbers, texts
from casario.operators import clean
from casario.plans.catalog import views
from casario.plans.catalog.registry import query
from casario.schemas import CONTEXT_FIELDS, RECORD_STRUCT
from casario.session import cut_lineage, scratch_path
from casario.sources import pages


@query(
    "to_numeric",
    """WITH k AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events),
t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN k || '.5' WHEN 3 THEN 'abc' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE k END AS v FROM k)
SELECT event_id, TRY_CAST(v AS DOUBLE) AS number, coalesce(TRY_CAST(v AS DOUBLE), 0) AS number_or_zero,
       CAST(v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL AS INTEGER) AS refused FROM t""",
)
def to_numeric(spark: SparkSession, folder: str) -> DataFrame:
    """List, text, decimal, words, empty list, empty text and bare number forms."""
    k, case = F.get_json_object("props", "$.k"), F.col("event_id") % 7
    text = (
        F.when(case == 0, F.concat(F.lit('["'), k, F.lit('","9"]')))
        .when(case == 1, F.concat(F.lit("["), k, F.lit("]")))
        .when(case == 2, F.concat(k, F.lit(".5")))
        .when(case == 3, F.lit("abc"))
        .when(case == 4, F.lit("[]"))
        .when(case == 5, F.lit(""))
        .otherwise(k)
    )
    typed = views.table(spark, folder, "events").select("event_id", text.alias("v"))
    return typed.select(
        "event_id",
        numbers.to_numeric(F.col("v")).alias("number"),
        numbers.to_numeric_or_zero(F.col("v")).alias("number_or_zero"),
        numbers.is_not_numeric(F.col("v")).cast("int").alias("refused"),
    )


@query(
    "first_of_list",
    """SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE string_split(p_name, ' ')[1] END AS first_or_null FROM part""",
)
def first_of_list(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split("p_name", " ")
    some = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(words)
    return views.table(spark, folder, "part").select(
        "p_partkey", F.get(words, F.lit(0)).alias("first_word"), F.get(some, F.lit(0)).alias("first_or_null")
    )


def _entry(kind: str, price: Column, condo: Column, period: Column | None) -> Column:
    info = F.struct(period.alias("period")) if period is not None else F.lit(None).cast("struct<period:string>")
    return F.struct(
        F.lit(kind).alias("businessType"), price.cast("string").alias("price"),
        condo.cast("string").alias("monthlyCondoFee"), info.alias("rentalInfo"),
    )


def searched_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders under their search: what a record is made of, the search context and one request per contract type."""
    k = F.col("o_orderkey")
    people = views.table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    kind = F.when(k % 3 == 0, "SALE").otherwise("RENTAL")
    return views.table(spark, folder, "orders").join(people, "o_custkey").select(
        k,
        "c_mktsegment",
        "o_orderdate",
        kind.alias("request_id"),
        F.lit("https://site.example").alias("site"),
        F.col("c_mktsegment").alias("neighborhood"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("locationId"),
        F.when(k % 103 != 0, F.lit("State")).alias("state"),
        F.lit("City").alias("city"),
        F.concat(F.lit("Z"), (k % 4).cast("string")).alias("zone"),
        kind.alias("business_type"),
        F.col("o_orderpriority").alias("listing_type"),
        F.concat(F.lit("portal"), (k % 2).cast("string")).alias("origin"),
    )


def portal_record(k: Column, segment: Column, date: Column) -> Column:
    """An order as a portal's record. One in about a hundred misses something, each fault under its own prime."""
    text = k.cast("string")
    rental = _entry(
        "RENTAL", F.lit(1000) + k % 5000, F.when(k % 2 == 0, k % 900),
        F.when(k % 10 == 0, "DAILY").otherwise("MONTHLY"),
    )
    sale = _entry("SALE", F.lit(300000) + k, F.lit(700), None)
    other = _entry("OTHER", F.lit(1), F.lit(1), None)
    moment = F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    address = F.struct(
        F.when(k % 6 != 0, F.concat(F.lit("Rua "), text)).alias("street"),
        F.when(k % 4 != 0, (k % 90).cast("string")).alias("streetNumber"),
        segment.alias("neighborhood"),
        F.when(k % 8 == 0, F.concat(F.lit("apto "), (k % 30).cast("string"))).alias("complement"),
        F.when(
            k % 17 != 0, F.struct(views.listing_lat(k).alias("lat"), views.listing_lon(k).alias("lon"))
        ).alias("point"),
    )
    fields = {
        "title": F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Title "), text)),
        "description": F.concat(F.lit("Description of listing "), text, F.lit(" with a long tail of words")),
        "amenities": F.when(k % 2 == 1, F.array(F.lit("POOL"), F.lit("GYM"))).otherwise(F.array(F.lit("ELEVATOR"))),
        "usableAreas": F.array((k % 300).cast("string")),
        "floors": k % 20,
        "bedrooms": F.when(k % 107 == 0, F.lit("abc")).otherwise((k % 5).cast("string")),
        "bathrooms": F.when(k % 3 == 0, F.lit("2.5")).otherwise(F.lit("1")),
        "parkingSpaces": F.array().cast("array<string>"),
        "unitTypes": F.when(k % 109 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("APARTMENT"), F.lit("FLAT"))),
        "pricingInfos": F.when(k % 113 == 0, F.array(other)).otherwise(F.array(other, rental, sale)),
        "address": address,
        "createdAt": moment,
        "updatedAt": F.when(k % 127 == 0, F.lit("not a date")).when(k % 19 != 0, moment),
    }
    medias = F.when(
        k % 9 != 0, F.array(F.struct(F.concat(F.lit("http://img/{action}/{width}x{height}/"), text, F.lit(".jpg")).alias("url")))
    )
    return F.struct(
        F.struct(*[c.alias(n) for n, c in fields.items()]).alias("listing"),
        medias.alias("medias"),
        F.struct(F.when(k % 101 != 0, F.concat(F.lit("/l/"), text)).alias("href")).alias("link"),
    )


def nested_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as portal records: the record fields, the search context and one request per contract type."""
    orders = searched_orders(spark, folder)
    made_of = ("o_orderkey", "c_mktsegment", "o_orderdate")
    return orders.select(
        "o_orderkey", "request_id", portal_record(*[F.col(c) for c in made_of]).alias("record"), *[c for c in orders.columns if c not in (*made_of, "request_id")]
    )


def cleaned_records(spark: SparkSession, folder: str) -> DataFrame:
    """The nested records through JSON text, as a landed page would hold them."""
    landed = nested_listings(spark, folder).withColumn("raw", F.to_json("record"))
    return clean.clean_listings(
        landed.select(F.inline(F.array(F.from_json("raw", RECORD_STRUCT))), *CONTEXT_FIELDS, "raw")
    )


RECORDS = f"""r AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS t, o_orderdate, o_orderpriority, c_mktsegment, c_nationkey,
         o_orderkey % 3 <> 0 AS rental FROM orders JOIN customer ON o_custkey = c_custkey),
good AS (SELECT * FROM r WHERE k % 101 <> 0 AND k % 103 <> 0 AND k % 107 <> 0 AND k % 109 <> 0 AND k % 113 <> 0 AND k % 127 <> 0),
priced AS (SELECT *, CAST(CASE WHEN rental THEN 1000 + k % 5000 ELSE 300000 + k END AS DOUBLE) AS price,
  CAST(CASE WHEN NOT rental THEN 700 WHEN k % 2 = 0 THEN k % 900 END AS DOUBLE) AS condo_fee FROM good)"""

_ADDRESS = """CASE WHEN k % 6 <> 0 AND k % 4 <> 0 THEN 'Rua ' || t || ', ' || CAST(k % 90 AS VARCHAR) || ' - ' || c_mktsegment
    WHEN k % 4 <> 0 THEN CAST(k % 90 AS VARCHAR) || ' - ' || c_mktsegment
    WHEN k % 6 <> 0 THEN 'Rua ' || t || ' - ' || c_mktsegment ELSE c_mktsegment END
  || CASE WHEN k % 8 = 0 THEN ' (apto ' || CAST(k % 30 AS VARCHAR) || ')' ELSE '' END"""


@query(
    "clean_listing",
    f"""WITH {RECORDS}
SELECT 'https://site.example/l/' || t AS url, c_mktsegment AS neighborhood, 'N' || CAST(c_nationkey AS VARCHAR) AS location_id,
  'Z' || CAST(k % 4 AS VARCHAR) AS zone, CASE WHEN rental THEN 'RENTAL' ELSE 'SALE' END AS business_type,
  CASE WHEN k % 5 = 0 THEN substr('Description of listing ' || t || ' with a long tail of words', 1, 40) ELSE 'Title ' || t END AS title,
  CAST(k % 300 AS DOUBLE) AS usable_area, CAST(k % 20 AS INTEGER) AS floors, 'APARTMENT' AS type_unit,
  CAST(k % 5 AS INTEGER) AS bedrooms, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS bathrooms, 0 AS suites, 0 AS parking_spaces,
  CASE WHEN k % 2 = 1 THEN 'POOL|GYM' ELSE 'ELEVATOR' END AS amenities,
  CASE WHEN k % 9 <> 0 THEN 'http://img/crop/264x200/' || t || '.jpg' ELSE '' END AS images,
  {_ADDRESS} AS address,
  CASE WHEN k % 17 <> 0 THEN round({views.LISTING_LAT.replace('o_orderkey', 'k')}, 9) END AS address_lat,
  CASE WHEN k % 17 <> 0 THEN round({views.LISTING_LON.replace('o_orderkey', 'k')}, 9) END AS address_lon,
  price, condo_fee,
  CASE WHEN rental AND k % 10 = 0 THEN price * 30 ELSE price END + coalesce(condo_fee, 0) AS total_fee,
  CAST(o_orderdate AS VARCHAR) AS created_date, CASE WHEN k % 19 <> 0 THEN CAST(o_orderdate AS VARCHAR) END AS updated_date
FROM priced""",
)
def clean_listing(spark: SparkSession, folder: str) -> DataFrame:
    usable = clean.accepted(cleaned_records(spark, folder))
    return usable.select(
        "url", "neighborhood", "location_id", "zone", "business_type", "title", "usable_area", "floors", "type_unit",
        "bedrooms", "bathrooms", "suites", "parking_spaces",
        F.array_join("amenities", "|").alias("amenities"), F.array_join("images", "|").alias("images"), "address",
        F.round("address_lat", 9).alias("address_lat"), F.round("address_lon", 9).alias("address_lon"),
        "price", "condo_fee", "total_fee",
        F.col("created_date").cast("string").alias("created_date"), F.col("updated_date").cast("string").alias("updated_date"),
    )


@query(
    "quarantine_counts",
    f"""WITH {RECORDS}, found AS (
  SELECT unnest(['missing:url', 'missing:state', 'not_numeric:bedrooms', 'no_unit_type', 'no_pricing', 'bad_updated_date']) AS reason,
         unnest([101, 103, 107, 109, 113, 127]) AS prime)
SELECT reason, count(*) AS rows FROM found JOIN r ON k % prime = 0 GROUP BY reason""",
)
def quarantine_counts(spark: SparkSession, folder: str) -> DataFrame:
    return clean.reject_counts(cleaned_records(spark, folder))


@query(
    "pick_pricing",
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus, o_totalprice FROM orders),
e AS (SELECT k, CASE o_orderstatus WHEN 'O' THEN 'SALE' ELSE 'RENTAL' END AS kind, o_totalprice,
  CASE WHEN k % 10 = 0 THEN 'DAILY' ELSE 'MONTHLY' END AS per, CASE WHEN k % 4 <> 0 THEN CAST(k % 900 AS DOUBLE) END AS condo FROM o WHERE k % 23 <> 0)
SELECT k AS o_orderkey, kind, CASE WHEN kind = 'RENTAL' THEN per END AS period,
  CASE kind WHEN 'SALE' THEN o_totalprice * 2 ELSE o_totalprice END AS price, condo AS condo_fee,
  round(CASE kind WHEN 'SALE' THEN o_totalprice * 2 WHEN 'RENTAL' THEN o_totalprice * CASE per WHEN 'DAILY' THEN 30 ELSE 1 END END + coalesce(condo, 0), 4) AS total_fee
FROM e
UNION ALL SELECT k, CASE o_orderstatus WHEN 'O' THEN 'SALE' ELSE 'RENTAL' END, NULL, NULL, NULL, NULL FROM o WHERE k % 23 = 0""",
)
def pick_pricing(spark: SparkSession, folder: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    condo = F.when(k % 4 != 0, (k % 900).cast("double"))
    entries = F.array(
        _entry("OTHER", price, condo, None),
        _entry("RENTAL", price, condo, F.when(k % 10 == 0, "DAILY").otherwise("MONTHLY")),
        _entry("SALE", price * 2, condo, None),
        _entry("SALE", price * 9, condo, None),
    )
    kind = F.when(F.col("o_orderstatus") == "O", "SALE").otherwise("RENTAL")
    infos = F.when(k % 23 == 0, F.filter(entries, lambda p: p["businessType"] == "OTHER")).otherwise(entries)
    picked = views.table(spark, folder, "orders").select(k, kind.alias("kind"), infos.alias("infos")).select(
        k, "kind", clean.pick_pricing(F.col("infos"), F.col("kind")).alias("p")
    )
    flat = picked.select(
        k, "kind", F.when(F.col("kind") == "RENTAL", F.col("p.rentalInfo.period")).alias("period"),
        numbers.to_numeric(F.col("p.price")).alias("price"), numbers.to_numeric(F.col("p.monthlyCondoFee")).alias("condo_fee"),
    )
    fee = clean.total_fee(F.col("kind"), F.col("period"), F.col("price"), F.col("condo_fee"))
    return flat.withColumn("total_fee", F.round(fee, 4))


@query(
    "address_text",
    """SELECT c_custkey,
  CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 THEN c_name || ', ' || CAST(c_custkey AS VARCHAR) || ' - ' || c_mktsegment
       WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS VARCHAR) || ' - ' || c_mktsegment
       WHEN c_custkey % 5 <> 0 THEN c_name || ' - ' || c_mktsegment ELSE c_mktsegment END
  || CASE WHEN c_custkey % 7 = 0 THEN ' (' || CAST(c_nationkey AS VARCHAR) || ')' ELSE '' END AS address,
  CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE 'None' END || ', ' || CAST(c_custkey AS VARCHAR) || ' - ' || c_mktsegment
       WHEN c_custkey % 5 <> 0 THEN c_name || ' - ' || c_mktsegment ELSE c_mktsegment END
  || CASE WHEN c_custkey % 7 = 0 THEN ' (' || CAST(c_nationkey AS VARCHAR) || ')' ELSE '' END AS literal_address
FROM customer""",
)
def address_text(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    parts = (
        F.when(k % 5 != 0, F.col("c_name")),
        F.when(k % 3 != 0, k.cast("string")),
        F.col("c_mktsegment"),
        F.when(k % 7 == 0, F.col("c_nationkey").cast("string")),
    )
    return views.table(spark, folder, "customer").select(
        k, texts.address_text(*parts).alias("address"), texts.address_text(*parts, as_written=True).alias("literal_address")
    )


@query(
    "location_name",
    """SELECT c_custkey, n_name || ', ' || r_name || ' - ' || substr(r_name, 1, 2) AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def location_name(spark: SparkSession, folder: str) -> DataFrame:
    nations, regions = views.table(spark, folder, "nation"), views.table(spark, folder, "region")
    path = F.concat(F.lit("BR>x>NULL>"), F.col("r_name"), F.lit(">zone>"), F.col("n_name"))
    return (
        views.table(spark, folder, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", texts.location_name(path, F.substring("r_name", 1, 2)).alias("name"))
    )


@query(
    "page_plan",
    """WITH t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
p AS (SELECT source, total, unnest(range(1, least(5, CAST(ceil(total / 8.0) AS BIGINT)) + 1)) AS page FROM t)
SELECT source, total, page, page * 8 AS "from" FROM p""",
)
def page_plan(spark: SparkSession, folder: str) -> DataFrame:
    totals = views.table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return pages.plan_pages(totals, size=8, max_page=5)


@query(
    "page_plan_all",
    """WITH t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
p AS (SELECT source, total, unnest(range(0, CAST(ceil(total / 24.0) AS BIGINT))) AS page FROM t)
SELECT source, total, page, page * 24 AS "from" FROM p""",
)
def page_plan_all(spark: SparkSession, folder: str) -> DataFrame:
    totals = views.table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return pages.plan_pages(totals, max_page=pages.ALL_PAGES, first_page=0)


@query(
    "failed_page_cut",
    """WITH cut AS (SELECT user_id, min(event_id) AS cut FROM events WHERE event_type = 'error' AND value > 20 GROUP BY user_id)
SELECT user_id, event_id FROM events LEFT JOIN cut USING (user_id) WHERE cut IS NULL OR event_id < cut""",
)
def failed_page_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Users as requests and events as their pages; a large error is the failed page."""
    bad = (F.col("event_type") == "error") & (F.col("value") > 20)
    events = views.table(spark, folder, "events")
    return pages.before_first_failure(events, ("user_id",), "event_id", bad).select("user_id", "event_id")


PER_PAGE = 24


def landed_documents(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """Writes the documents as page files, up to 24 per page, and returns path and requests.

    A page's records are gathered by page, never by source. Page 7 of a request has no search result, and records have
    fields that no schema names.
    """
    docs = views.table(spark, folder, "documents").select(
        F.concat(F.lit("portal"), (F.col("doc_id") % 2).cast("string")).alias("origin"),
        F.col("lang").alias("request_id"),
        (F.floor(F.col("doc_id") / (2 * PER_PAGE)) + 1).cast("int").alias("page"),
        "doc_id", "text", "n_chars",
    )
    record = F.struct(
        F.struct(
            F.col("text").alias("description"), F.lit("").alias("title"), F.col("n_chars").cast("string").alias("usableAreas"),
            F.struct(F.col("doc_id").alias("number")).alias("unlisted"),
        ).alias("listing"),
        F.struct(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("href"), F.lit("name").alias("name")).alias("link"),
        F.array("n_chars").alias("unknown"),
    )
    counted = docs.groupBy("origin", "request_id").agg(F.count(F.lit(1)).alias("totalCount"))
    found = (
        docs.groupBy("origin", "request_id", "page")
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", record.alias("r")))).alias("rows"))
        .join(counted, ["origin", "request_id"])
        .select(
            "origin", "request_id", "page", F.lit(200).alias("status"),
            F.when(
                F.col("page") % 50 != 7,
                F.struct("totalCount", F.struct(F.transform("rows", lambda x: x["r"]).alias("listings")).alias("result")),
            ).alias("search"),
        )
    )
    path = scratch_path(spark, "pages")
    found.write.json(path)
    requests = docs.select("origin", "request_id").distinct().select(
        "origin", "request_id",
        F.concat(F.lit("https://"), F.col("origin"), F.lit(".example")).alias("site"),
        *[F.concat(F.lit(f"{c} "), F.col("request_id")).alias(c) for c in CONTEXT_FIELDS if c not in ("site", "origin")],
    )
    return path, requests


@query(
    "ingest_pages",
    """SELECT 'portal' || CAST(doc_id % 2 AS VARCHAR) AS origin, lang AS request_id, CAST(doc_id // 48 + 1 AS INTEGER) AS page,
  CAST(row_number() OVER (PARTITION BY doc_id % 2, lang, doc_id // 48 ORDER BY doc_id) - 1 AS INTEGER) AS position,
  'https://portal' || CAST(doc_id % 2 AS VARCHAR) || '.example/d/' || CAST(doc_id AS VARCHAR) AS url,
  'zone ' || lang AS zone, md5(text) AS text_md5, CAST(n_chars AS VARCHAR) AS chars
FROM documents WHERE (doc_id // 48 + 1) % 50 <> 7""",
)
def ingest_pages(spark: SparkSession, folder: str) -> DataFrame:
    path, requests = landed_documents(spark, folder)
    rows = pages.stamp(pages.records(pages.read_pages(spark, path)), requests)
    return rows.select(
        "origin", "request_id", "page", "position", F.concat("site", "link.href").alias("url"), "zone",
        F.md5("listing.description").alias("text_md5"), F.col("listing.usableAreas").alias("chars"),
    )


@query(
    "raw_roundtrip",
    """SELECT 'https://portal' || CAST(doc_id % 2 AS VARCHAR) || '.example/d/' || CAST(doc_id AS VARCHAR) AS url,
  CAST(doc_id AS VARCHAR) AS number, 'name' AS name, CAST(n_chars AS VARCHAR) AS unknown, 'zone ' || lang AS zone, md5(text) AS text_md5
FROM documents WHERE (doc_id // 48 + 1) % 50 <> 7""",
)
def raw_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the landed records that no schema names, read back out of ``raw``."""
    path, requests = landed_documents(spark, folder)
    rows = pages.stamp(pages.records(pages.read_pages(spark, path)), requests)

    def field(name: str) -> Column:
        return F.get_json_object("raw", f"$.{name}")

    return rows.select(
        F.concat("site", "link.href").alias("url"), field("listing.unlisted.number").alias("number"), field("link.name").alias("name"),
        field("unknown[0]").alias("unknown"), field("zone").alias("zone"), F.md5(field("listing.description")).alias("text_md5"),
    )


@query(
    "page_rejects",
    """SELECT 'malformed_page' AS reason, count(DISTINCT (doc_id % 2, lang, doc_id // 48)) AS pages FROM documents WHERE (doc_id // 48 + 1) % 50 = 7 HAVING count(*) > 0
UNION ALL SELECT 'corrupt_page', count(DISTINCT (doc_id % 2, lang)) FROM documents""",
)
def page_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that hold no listings, by reason: bodies without a search result, and one broken line for each request."""
    path, requests = landed_documents(spark, folder)
    requests.select(F.concat(F.lit('{"origin": "'), "origin", F.lit('", "request_id": '), "request_id")).write.mode("append").text(path)
    rejects = cut_lineage(pages.rejected_pages(pages.read_pages(spark, path), requests))
    return rejects.groupBy(F.get("reject_reasons", F.lit(0)).alias("reason")).agg(F.count(F.lit(1)).alias("pages"))


@query(
    "page_totals",
    """SELECT 'portal' || CAST(doc_id % 2 AS VARCHAR) AS origin, lang AS request_id, count(*) AS total,
  count(DISTINCT doc_id // 48) FILTER ((doc_id // 48 + 1) % 50 = 7) AS malformed_pages FROM documents GROUP BY 1, 2""",
)
def page_totals(spark: SparkSession, folder: str) -> DataFrame:
    path, _ = landed_documents(spark, folder)
    landed = pages.read_pages(spark, path)
    broken = pages.malformed(landed).groupBy("origin", "request_id").agg(F.count(F.lit(1)).alias("malformed_pages"))
    return (
        pages.total_listings(landed)
        .join(broken, ["origin", "request_id"], "left")
        .withColumn("malformed_pages", F.coalesce("malformed_pages", F.lit(0)))
    )


@query(
    "json_flatten",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS "props.k", event_type AS "source.type", value AS "source.inner.value" FROM events""",
)
def json_flatten(spark: SparkSession, folder: str) -> DataFrame:
    events = views.table(spark, folder, "events")
    nested = events.select(
        "event_id", F.from_json("props", "k bigint").alias("props"),
        F.struct(F.col("event_type").alias("type"), F.struct("value").alias("inner")).alias("source"),
    )
    return clean.flatten(nested)


@query(
    "null_safe_ne",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CASE event_type WHEN 'click' THEN 'SALE' ELSE 'RENTAL' END END AS "businessType",
  CASE WHEN event_id % 3 <> 0 THEN CASE WHEN value > 10 THEN 'MONTHLY' ELSE 'DAILY' END END AS period FROM events
WHERE (CASE WHEN event_id % 5 <> 0 THEN CASE event_type WHEN 'click' THEN 'SALE' ELSE 'RENTAL' END END) IS DISTINCT FROM 'SALE'
  AND (CASE WHEN event_id % 3 <> 0 THEN CASE WHEN value > 10 THEN 'MONTHLY' ELSE 'DAILY' END END) IS DISTINCT FROM 'MONTHLY'""",
)
def null_safe_ne(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id")
    entries = views.table(spark, folder, "events").select(
        k,
        F.when(k % 5 != 0, F.when(F.col("event_type") == "click", "SALE").otherwise("RENTAL")).alias("businessType"),
        F.when(k % 3 != 0, F.when(F.col("value") > 10, "MONTHLY").otherwise("DAILY")).alias("period"),
    )
    return pages.not_sale_nor_monthly(entries)


@query(
    "unusual_rentals",
    f"""WITH {RECORDS}
SELECT 'https://site.example/l/' || t AS url, e.b AS "businessType", e.p AS period FROM good,
  LATERAL (SELECT unnest(['OTHER', 'RENTAL']) AS b, unnest([NULL, CASE WHEN k % 10 = 0 THEN 'DAILY' ELSE 'MONTHLY' END]) AS p) e
WHERE e.p IS DISTINCT FROM 'MONTHLY'""",
)
def unusual_rentals(spark: SparkSession, folder: str) -> DataFrame:
    """Pricing entries out of the stored raw JSON."""
    return pages.unusual_rentals(clean.accepted(cleaned_records(spark, folder)).select("url", "raw"))


@query(
    "variant_scan",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events",
)
def variant_scan(spark: SparkSession, folder: str) -> DataFrame:
    events = views.table(spark, folder, "events").select("event_id", F.try_parse_json("props").alias("raw"))
    return events.select(
        "event_id", F.try_variant_get("raw", "$.k", "bigint").alias("k"),
        F.try_variant_get("raw", "$.missing", "string").alias("missing"),
    )


