"""Change gate, merge, active set and the refresh cycle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from casario.operators import serve, upsert
from casario.plans import refresh
from casario.plans.catalog import cleaning, views
from casario.plans.catalog.registry import query
from casario.session import cut_lineage, scratch_path
from casario.sources import pages
from casario.sources.tables import Store, buckets_for
from casario.streaming import ingest

# How the observation table plugs into the generic merge.
KEYED = {"seq": "event_id", "date": "seen", "immutable": ("event_type",), "mutable": ("value", "ts", "seen")}
STATE_TYPES = {
    "user_id": "bigint",
    "event_type": "string",
    "value": "double",
    "ts": "timestamp",
    "seen": "timestamp",
    "total_fee_predict": "double",
    "created": "timestamp",
    "updated": "timestamp",
}

_FOLD = """SELECT user_id, arg_min(event_type, event_id) AS event_type,
       arg_max(value, event_id) FILTER (applied) AS value,
       CAST(arg_max(ts, event_id) FILTER (applied) AS VARCHAR) AS ts"""


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    return views.observations(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("string"))


@query(
    "day_gate",
    f"WITH {views.OBSERVATION}, {views.marked_sql('observation')} SELECT user_id, event_id, CAST(applied AS INTEGER) AS applied FROM marked",
)
def day_gate(spark: SparkSession, folder: str) -> DataFrame:
    marked = upsert.mark_applied(
        views.observations(spark, folder).select("user_id", "event_id", "seen"), "user_id", "event_id", "seen"
    )
    return marked.select("user_id", "event_id", F.col("applied").cast("int").alias("applied"))


@query(
    "batch_fold",
    f"WITH {views.OBSERVATION}, {views.marked_sql('observation')} {_FOLD} , CAST(count(*) FILTER (applied) AS BIGINT) AS runs FROM marked GROUP BY user_id",
)
def batch_fold(spark: SparkSession, folder: str) -> DataFrame:
    folded = upsert.fold_batch(_observed(spark, folder), key="user_id", **KEYED)
    return _text(folded).select("user_id", "event_type", "value", "ts", F.col("_runs").alias("runs"))


CUT = "2024-01-16 00:00:00"

# Every event is in one batch. A fourth of the users is new in the second batch, a fifth (of the others) ends with the first.
_SPLIT = f"""{views.OBSERVATION}, chained AS (
  SELECT *, CASE WHEN user_id % 4 = 0 THEN true WHEN user_id % 5 = 0 THEN false ELSE coalesce(ts >= TIMESTAMP '{CUT}', false) END AS incoming FROM observation)"""


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two batches that hold every event once: a quarter of the users is new in the second, a fifth of the others is in the first only."""
    seen, user = _observed(spark, folder), F.col("user_id")
    incoming = F.when(user % 4 == 0, True).when(user % 5 == 0, False).otherwise(
        F.coalesce(F.col("ts") >= F.lit(CUT).cast("timestamp"), F.lit(False))
    )
    return seen.where(~incoming), seen.where(incoming)


@query(
    "upsert_merge",
    f"""WITH {_SPLIT}, {views.marked_sql('chained')}
{_FOLD}, CASE WHEN bool_and(incoming) THEN 'insert' WHEN coalesce(bool_or(applied) FILTER (incoming), false) THEN 'update' ELSE 'keep' END AS op
FROM marked GROUP BY user_id""",
)
def upsert_merge(spark: SparkSession, folder: str) -> DataFrame:
    before, after = _split(spark, folder)
    stored = upsert.fold_batch(before, key="user_id", **KEYED).drop("_runs")
    folded = upsert.fold_batch(after, key="user_id", **KEYED)
    rules = {k: v for k, v in KEYED.items() if k != "seq"}
    merged = upsert.merge(stored, folded, key="user_id", **rules)
    return _text(merged).select("user_id", "event_type", "value", "ts", F.col("_op").alias("op"))


@query(
    "forced_merge",
    f"""WITH {_SPLIT}
SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_max(value, event_id) AS value,
       CAST(arg_max(ts, event_id) AS VARCHAR) AS ts FROM chained GROUP BY user_id""",
)
def forced_merge(spark: SparkSession, folder: str) -> DataFrame:
    before, after = _split(spark, folder)
    rules = {k: v for k, v in KEYED.items() if k != "seq"}
    stored = upsert.fold_batch(before, key="user_id", force=True, **KEYED).drop("_runs")
    folded = upsert.fold_batch(after, key="user_id", force=True, **KEYED)
    return _text(upsert.merge(stored, folded, key="user_id", force=True, **rules)).select("user_id", "event_type", "value", "ts")


@query(
    "refresh_cycle",
    f"""WITH {_SPLIT}, {views.marked_sql('chained')}, final AS ({_FOLD} FROM marked GROUP BY user_id)
SELECT *, CASE WHEN user_id % 2 = 0 THEN round(value * 2, 4) END AS total_fee_predict FROM final""",
)
def refresh_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches merged through the stored table, then predictions written back."""
    store = Store(spark, scratch_path(spark, "cycle"), buckets=8, listing_types=STATE_TYPES, key="user_id")
    for batch in _split(spark, folder):
        refresh.merge_into(store, batch, **KEYED)
    table = store.read("listing")
    even = table.where(F.col("user_id") % 2 == 0).select("user_id", F.round(F.col("value") * 2, 4).alias("prediction"))
    store.replace_partitions("listing", upsert.write_back(table, even, key="user_id"))
    return _text(store.read("listing")).select("user_id", "event_type", "value", "ts", "total_fee_predict")


# Page files are read whole, as they are compressed: this many pages lie in one.
_LANDING = {"compression": "gzip", "maxRecordsPerFile": 20_000}
_ASKED = ("request_id", "origin", "business_type", "listing_type", "locationId")


def landed_searches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nested records as page files per search (portal, contract, kind, nation), at most 24 a page."""
    path, asked = _land_searches(spark, folder)
    return pages.read_pages(spark, path), asked


def _land_searches(spark: SparkSession, folder: str, by: Column | None = None) -> tuple[str, DataFrame]:
    """(folder of the page files, the searches). ``by`` puts pages into one folder (``part``) for each of its few values.

    Records are some 50 times larger than what they are made of, so they are made on their page, after the shuffle.
    """
    found = cleaning.searched_orders(spark, folder).withColumn(
        "request_id", F.concat_ws("|", "business_type", "listing_type", "locationId")
    )
    made_of = ("o_orderkey", "c_mktsegment", "o_orderdate")
    paged = found.groupBy(*_ASKED, F.floor(F.col("o_orderkey") / F.lit(24)).cast("int").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct(*made_of))).alias("rows")
    )
    records = F.transform("rows", lambda r: cleaning.portal_record(*[r[c] for c in made_of]))
    path = scratch_path(spark, "searches")
    paged, parts = paged.withColumn("page", F.col("page") + 1), []
    if by is not None:
        # sorted before records are made: the writer has one folder open at a time
        paged, parts = paged.withColumn("part", by).sortWithinPartitions("part"), ["part"]
    landing = paged.select(
        "origin", "request_id", "page", F.lit(200).alias("status"),
        F.struct(F.size("rows").alias("totalCount"), F.struct(records.alias("listings")).alias("result")).alias("search"), *parts,
    ).write.options(**_LANDING)
    (landing.partitionBy(*parts) if parts else landing).json(path)
    asked = found.select(*_ASKED).distinct()
    fixed = {"site": "https://site.example", "neighborhood": "Area", "state": "State", "city": "City", "zone": "Zone"}
    return path, asked.withColumns({c: F.lit(v) for c, v in fixed.items()})


_LANDED = f"""WITH {cleaning.RECORDS.replace('k % 103 <> 0 AND ', '')}
SELECT 'https://site.example/l/' || t AS url, 'N' || CAST(c_nationkey AS VARCHAR) AS location_id,
  CASE WHEN rental THEN 'RENTAL' ELSE 'SALE' END AS business_type, o_orderpriority AS listing_type,
  CAST(k % 5 AS INTEGER) AS bedrooms, CASE WHEN rental AND k % 10 = 0 THEN price * 30 ELSE price END + coalesce(condo_fee, 0) AS total_fee,
  CASE WHEN k % 19 <> 0 THEN CAST(o_orderdate AS VARCHAR) END AS updated_date FROM priced"""


def _buckets(spark: SparkSession, folder: str) -> int:
    return max(8, buckets_for(views.table(spark, folder, "orders").count()))


def _shown(listings: DataFrame) -> DataFrame:
    return listings.select(
        "url", "location_id", "business_type", "listing_type", "bedrooms", "total_fee",
        F.col("updated_date").cast("string").alias("updated_date"),
    )


@query("refresh_pages", _LANDED)
def refresh_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The cycle over every search: landed pages, cleaning, merge, activation, read; without stations and model."""
    landed, asked = landed_searches(spark, folder)
    store = Store(spark, scratch_path(spark, "refresh"), buckets=_buckets(spark, folder))
    refresh.refresh(store, landed, cut_lineage(asked), dt.datetime(2002, 1, 1))
    return _shown(serve.active_listings(store.read("listing"), store.read("active")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files of a folder; none if no page went there."""
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "value string")


@query("stream_pages", _LANDED)
def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The landed pages as a stream that stops after half of them and is started again on the same checkpoint.

    Half of the pages land before the first run; the second run finds the other half and, sent once more, the first half.
    """
    # lines are sent as they are, and never parsed on their way
    path, asked = _land_searches(spark, folder, by=F.pmod(F.xxhash64("request_id", "page"), F.lit(2)))
    halves = [read_lines(spark, f"{path}/part={k}") for k in range(2)]
    files = max(1, min(h.rdd.getNumPartitions() for h in halves))
    work = scratch_path(spark, "pages")
    store = Store(spark, f"{work}/tables", buckets=_buckets(spark, folder))
    asked = cut_lineage(asked)
    for later in (False, True):
        for half in halves if later else halves[:1]:
            half.coalesce(files).write.mode("append").text(f"{work}/landing", compression="gzip")
        ingest.ingest_pages(spark, f"{work}/landing", asked, store, f"{work}/offsets", files_per_trigger=files).awaitTermination()
    return _shown(store.read("listing"))


TRIGGERS = 4


def arriving(spark: SparkSession, folder: str, by: Column) -> DataFrame:
    """The events as a stream of ``TRIGGERS`` pieces in the order of a number, one piece per trigger, each of equally many files."""
    events = views.table(spark, folder, "events")
    path = scratch_path(spark, "arriving")
    shares = [k / TRIGGERS for k in range(1, TRIGGERS)]
    cuts = events.agg(F.percentile_approx(by, shares).alias("cuts")).first()["cuts"]
    piece = sum((F.when(by > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    sizes = dict(events.groupBy(piece.alias("piece")).count().collect())
    # a task with as many rows as files puts one into each, and so many rows leave one such task
    least = min(sizes.get(k, 0) for k in range(TRIGGERS))
    files = max(1, min(spark.sparkContext.defaultParallelism, least // max(1, events.rdd.getNumPartitions())))
    for k in range(TRIGGERS):
        events.where(piece == k).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(
    "stream_upsert",
    f"WITH {views.OBSERVATION}, {views.marked_sql('observation')} {_FOLD} FROM marked GROUP BY user_id",
)
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of several files, merged into a stored table trigger by trigger."""
    work = scratch_path(spark, "stream")
    store = Store(spark, f"{work}/tables", buckets=8, listing_types=STATE_TYPES, key="user_id")
    stream = arriving(spark, folder, F.col("event_id"))
    key = F.col("event_id")
    moved = F.col("ts").cast("timestamp") + F.make_dt_interval((key % 3).cast("int"))
    seen = stream.select(
        "user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"),
        F.when(key % 11 != 0, moved).alias("seen"),
    )
    merge = ingest.merge_stream(seen, lambda batch, _: refresh.merge_into(store, batch, **KEYED), f"{work}/offsets")
    merge.awaitTermination()
    return _text(store.read("listing")).select("user_id", "event_type", "value", "ts")


@query(
    "stream_dedupe",
    """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 1 AS kept FROM events GROUP BY user_id, CAST(ts AS DATE)""",
)
def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Re-sent observations of a key and day are dropped; each trigger holds days of the whole span, so most rows are late."""
    work = scratch_path(spark, "dedupe")
    stream = arriving(spark, folder, F.xxhash64("event_id"))
    timed = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    ingest.merge_stream(timed, ingest.keep_fresh(f"{work}/rows", "user_id", "ts"), f"{work}/offsets").awaitTermination()
    kept = spark.read.schema("user_id bigint, ts timestamp").parquet(f"{work}/rows")
    return kept.groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).cast("int").alias("kept")
    )


@query(
    "insert_if_absent",
    f"""WITH {views.ACTIVE}
SELECT url, location_id, business_type, listing_type FROM listing
WHERE url NOT IN (SELECT url FROM active WHERE listing_type <> '1-URGENT')""",
)
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    batch = views.listings(spark, folder).withColumn("seq", F.col("o_orderkey"))
    surviving = views.active(spark, folder).where(F.col("listing_type") != "1-URGENT")
    return upsert.new_active(batch, surviving).select("url", "location_id", "business_type", "listing_type")


@query(
    "fk_check",
    f"""WITH {views.ACTIVE}
SELECT url, location_id FROM active WHERE url NOT IN (SELECT url FROM listing WHERE listing_type <> '5-LOW')""",
)
def fk_check(spark: SparkSession, folder: str) -> DataFrame:
    known = views.offers(spark, folder).where(F.col("listing_type") != "5-LOW")
    return upsert.orphans(views.active(spark, folder), known).select("url", "location_id")


@query(
    "replace_segment",
    f"""WITH {views.ACTIVE}, cleared AS (SELECT * FROM active WHERE NOT (business_type = 'O' AND listing_type IN ('5-LOW', '2-HIGH'))),
batch AS (SELECT url, location_id, business_type, listing_type FROM listing WHERE business_type = 'O' AND listing_type = '5-LOW' AND o_orderkey % 2 = 0)
SELECT url, location_id, business_type, listing_type FROM cleared
UNION ALL SELECT * FROM batch WHERE url NOT IN (SELECT url FROM cleared)""",
)
def replace_segment(spark: SparkSession, folder: str) -> DataFrame:
    """Two contract segments are cleared on disk; one comes back with new rows, one stays empty."""
    store = Store(spark, scratch_path(spark, "segments"))
    store.append("active", views.active(spark, folder))
    listings = views.listings(spark, folder)
    target = (F.col("business_type") == "O") & F.col("listing_type").isin("5-LOW", "2-HIGH")
    segments = listings.where(target).select("business_type", "listing_type", "location_id").distinct()
    batch = listings.where(target & (F.col("listing_type") == "5-LOW") & (F.col("o_orderkey") % 2 == 0))
    refresh.activate(store, segments, batch.withColumn("seq", F.col("o_orderkey")), dt.datetime(2002, 1, 1))
    return store.read("active").select("url", "location_id", "business_type", "listing_type")
