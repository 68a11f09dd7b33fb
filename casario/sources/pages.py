"""Landed listing pages: planning, reading, stamping and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casario.schemas import CONTEXT_FIELDS, PAGE, RECORD_FIELDS, RECORD_STRUCT
from casario.session import cut_lineage

PAGE_SIZE = 24
ALL_PAGES = -1


def plan_pages(
    requests: DataFrame, size: int = PAGE_SIZE, max_page: int = 50, first_page: int = 1, total: str = "total"
) -> DataFrame:
    """One row per page to fetch, with its offset ``from``.

    ``max_page`` caps the pages per request; -1 takes them all. Pages are numbered from
    ``first_page``; the default leaves out the rows before the first full offset.
    """
    pages = F.ceil(F.col(total) / F.lit(float(size))).cast("bigint")
    last = pages if max_page == ALL_PAGES else F.least(F.lit(max_page).cast("bigint"), pages)
    last = last + F.lit(first_page - 1)
    numbers = F.when(last >= first_page, F.sequence(F.lit(first_page).cast("bigint"), last))
    return requests.withColumn("page", F.explode(numbers)).withColumn("from", F.col("page") * F.lit(size))


def read_pages(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Page documents, one JSON object per line. FAILFAST stops at the first broken one."""
    schema = PAGE if mode == "PERMISSIVE" else PAGE.replace(", _corrupt_record string", "")
    return spark.read.schema(schema).option("mode", mode).json(path)


def corrupt(pages: DataFrame) -> Column:
    """Lines that are no JSON object; a reader that stops at them has no such column."""
    return F.col("_corrupt_record").isNotNull() if "_corrupt_record" in pages.columns else F.lit(False)


def malformed(pages: DataFrame) -> DataFrame:
    """Page documents without a search envelope."""
    return pages.where(~corrupt(pages) & F.col("search").isNull() & (F.coalesce(F.col("status"), F.lit(200)) < 400))


def rejected_pages(pages: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Pages that hold no listings, as rejects with reason and text: broken lines, and bodies without an envelope.

    With ``requests`` only bodies of these are returned; a broken line does not say whose it is.
    """
    bodies = malformed(pages)
    if requests is not None:
        bodies = bodies.join(requests.select("origin", "request_id"), ["origin", "request_id"], "left_semi")
    text = F.to_json(F.struct("origin", "request_id", "page", "status"))
    none = F.lit(None).cast("string").alias("url")
    out = bodies.select(none, "origin", F.array(F.lit("malformed_page")).alias("reject_reasons"), text.alias("raw"))
    if "_corrupt_record" not in pages.columns:
        return out
    broken = pages.where(corrupt(pages)).select(
        none, "origin", F.array(F.lit("corrupt_page")).alias("reject_reasons"), F.col("_corrupt_record").alias("raw")
    )
    return out.unionByName(broken)


def total_listings(pages: DataFrame) -> DataFrame:
    return pages.groupBy("origin", "request_id").agg(F.max("search.totalCount").alias("total"))


def failed(pages: DataFrame) -> Column:
    return F.coalesce(F.col("status") >= 400, F.lit(False))


def before_first_failure(
    pages: DataFrame, by: tuple[str, ...] = ("origin", "request_id"), page: str = "page", bad: Column | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Pages of each request that come before its first failed one. ``known`` has failed pages seen elsewhere.

    One failure row per request is joined back, so a request of any size is never gathered.
    The failures are few and written first: the pages are not shuffled to meet them.
    """
    bad = failed(pages) if bad is None else bad
    failures = pages.where(bad).select(*by, page)
    if known is not None:
        failures = failures.unionByName(known.select(*by, page))
    cut = cut_lineage(failures.groupBy(*by).agg(F.min(page).alias("_cut")))
    return (
        pages.join(cut, list(by), "left")
        .where(F.col("_cut").isNull() | (F.col(page) < F.col("_cut")))
        .drop("_cut")
    )


def records(pages: DataFrame) -> DataFrame:
    """One row per listing record: page, position, request, typed fields, and the record's own text."""
    return (
        pages.where(F.col("search").isNotNull())
        .select("origin", "request_id", "page", F.posexplode("search.result.listings").alias("position", "record_text"))
        .select(
            "origin", "request_id", "page", "position", "record_text",
            F.inline(F.array(F.from_json("record_text", RECORD_STRUCT))),
        )
    )


def overlaid(text: Column, more: Column) -> Column:
    """A JSON object's text with the fields of another's put behind its own, where they win on equal names."""
    body = F.rtrim(text)
    # by bytes: counting characters would read a long text again and again
    octets = body.cast("binary")
    inside = F.rtrim(F.substring(octets, F.lit(1), F.length(octets) - 1).cast("string"))
    empty = (F.octet_length(inside) <= 4) & (F.char_length(inside) <= 1)
    return F.when(
        body.endswith("}"), F.concat(inside, F.when(empty, "").otherwise(","), F.substring(more, F.lit(2), F.length(more)))
    ).otherwise(more)


def numbered(requests: DataFrame) -> DataFrame:
    """Requests with ``request_seq``, the order in which they count: the caller's, or that of their names.

    One row per search, so numbering them is a window over a short list.
    """
    if "request_seq" in requests.columns:
        return requests
    order = Window.orderBy("origin", "request_id")
    return requests.withColumn("request_seq", F.dense_rank().over(order))


def stamp(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Overlays the search context on every record; the context wins on equal names.

    ``raw`` is the record as landed with the context in it. ``seq`` orders records over all requests.
    """
    own = [c for c in rows.columns if c not in CONTEXT_FIELDS or c == "origin"]
    # the context's text is made once a request, not once a record
    context = numbered(requests).select("request_id", "request_seq", *CONTEXT_FIELDS, F.to_json(F.struct(*CONTEXT_FIELDS)).alias("_context"))
    stamped = rows.select(*own).join(context, ["origin", "request_id"])
    raw = overlaid(F.col("record_text"), F.col("_context"))
    seq = sequence_number(F.col("request_seq"), F.col("page"), F.col("position"))
    return stamped.withColumns({"raw": raw, "seq": seq}).drop("record_text", "request_seq", "_context")


def sequence_number(request: Column, page: Column, position: Column) -> Column:
    """Order of a record: by request, page and position; room for a million records a page and pages a request."""
    return (request.cast("bigint") * F.lit(1_000_000) + page) * F.lit(1_000_000) + position


def raw_records(stored: DataFrame) -> DataFrame:
    """url and parsed record of stored raw JSON."""
    fields = {**RECORD_FIELDS, **{c: "string" for c in CONTEXT_FIELDS}}
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    # inline parses each text once, whatever is filtered or selected afterwards
    return stored.select("url", F.inline(F.array(F.from_json("raw", schema))))


def unusual_rentals(stored: DataFrame) -> DataFrame:
    """Pricing entries that are neither a sale nor monthly; entries lacking either field are kept."""
    entries = raw_records(stored).select("url", F.explode_outer("listing.pricingInfos").alias("p"))
    return not_sale_nor_monthly(
        entries.select("url", F.col("p.businessType").alias("businessType"), F.col("p.rentalInfo.period").alias("period"))
    )


def not_sale_nor_monthly(entries: DataFrame) -> DataFrame:
    return entries.where(
        ~F.col("businessType").eqNullSafe(F.lit("SALE")) & ~F.col("period").eqNullSafe(F.lit("MONTHLY"))
    )


