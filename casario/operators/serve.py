"""Queries over the stored listings: filter, rank, page, bounds and map aggregates."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casario.functions import numbers, texts
from casario.operators.ranks import grouped_median, keys_at
from casario.schemas import SEGMENT

TABLE_COLUMNS = ("title", "usable_area", "type_unit", "estacao", "distance", "total_fee", "total_fee_predict")
PAGE_SIZE = 25
# The first pages are one top-k, as each task keeps this many rows at most; deeper ones are located by position.
TOP_K_ROWS = 40 * PAGE_SIZE
# A page of a stored order reads whole files, so this bounds what it reads.
FILE_ROWS = 1_000_000


def in_segment(df: DataFrame, business_type: str, listing_type: str, location_id: str) -> DataFrame:
    values = dict(zip(SEGMENT, (business_type, listing_type, location_id)))
    for name, value in values.items():
        df = df.where(F.col(name) == value)
    return df


def active_listings(listings: DataFrame, active: DataFrame) -> DataFrame:
    """Listings whose url is active. The url is unique in ``active``, so a semi join is enough."""
    return listings.join(active.select("url"), "url", "left_semi")


def within(df: DataFrame, price: tuple[float, float], rooms: tuple[int, int]) -> DataFrame:
    """Inclusive bounds on price and bedrooms; rows with nulls fall out."""
    return df.where(F.col("total_fee").between(*price) & F.col("bedrooms").between(*rooms))


def with_residual(df: DataFrame) -> DataFrame:
    return df.withColumn("error", F.col("total_fee") - F.col("total_fee_predict"))


def display_rounded(df: DataFrame) -> DataFrame:
    """Distance and prediction to whole numbers; applied before sorting."""
    return df.withColumns({c: F.bround(c, 0) for c in ("distance", "total_fee_predict") if c in df.columns})


def sort_columns(sort_by: list[tuple[str, str]], key: str = "url") -> list[Column]:
    """Caller's (column, asc|desc) list, nulls last both ways, then the key."""
    chosen = sort_by or [("error", "asc")]
    order = [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last() for c, d in chosen]
    return [*order, F.col(key).asc_nulls_last()]


def page_of(
    df: DataFrame,
    page: int,
    size: int = PAGE_SIZE,
    sort_by: list[tuple[str, str]] | None = None,
    key: str = "url",
    top_k: int = TOP_K_ROWS,
) -> DataFrame:
    """Rows ``[page*size, (page+1)*size)`` of the sorted result.

    Null and repeated keys are rows like others; rows that tie in order and key follow the text of the row, so a page
    holds the same rows however deep it lies.
    """
    whole = F.to_json(F.struct(*df.columns))
    order = [*sort_columns(sort_by or [], key), whole]
    start = page * size
    if start + size <= top_k:
        return df.orderBy(*order).offset(start).limit(size)
    found = keys_at(df, order, df.columns, list(range(start, start + size)))
    rows = [tuple(row[c] for c in df.columns) for _, row in sorted(found.items())]
    return df.sparkSession.createDataFrame(rows, df.schema)


def store_order(
    df: DataFrame, path: str, sort_by: list[tuple[str, str]] | None = None, key: str = "url", file_rows: int = FILE_ROWS
) -> None:
    """Writes the rows in page order below ``path``, with the first position of every file, for ``stored_page``.

    Rows that tie in order and key follow a hash of the row, so no page depends on the run; equal rows are interchangeable.
    One global sort serves all pages until the rows change; ``path`` must be new.
    """
    tie = F.xxhash64(F.to_json(F.struct(*df.columns)))
    ordered = df.orderBy(*sort_columns(sort_by or [], key), tie)
    ordered.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    files = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    # one row a file; the number of the task, then that of its file
    before = Window.orderBy(
        F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"), F.regexp_extract("file", r"-c(\d+)\.", 1).cast("long")
    ).rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/starts")


def stored_page(spark: SparkSession, path: str, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """Rows ``[page*size, (page+1)*size)`` of a stored order. Only the files that hold them are read; past the end there are none."""
    first = page * size
    schema = spark.read.parquet(f"{path}/rows").schema
    files = spark.read.parquet(f"{path}/starts").where((F.col("start") < first + size) & (F.col("start") + F.col("rows") > first))
    place = "__place"
    parts = [
        spark.read.schema(schema).parquet(f"{path}/rows/{f['file']}")
        .select(*schema.names, (F.col("_metadata.row_index") + f["start"]).alias(place))
        .where(F.col(place).between(first, first + size - 1))
        for f in files.collect()
    ]
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts).orderBy(place).drop(place)


def table_page(
    df: DataFrame, page: int = 0, size: int = PAGE_SIZE, sort_by: list[tuple[str, str]] | None = None
) -> DataFrame:
    """One page of the best-value table: residual, rounding, order, link, seven columns."""
    ranked = display_rounded(with_residual(df))
    return page_of(ranked, page, size, sort_by).select(
        texts.markdown_link(F.col("title"), F.col("url")).alias("title"),
        *[c for c in TABLE_COLUMNS if c != "title"],
    )


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", numbers.page_total(F.col("rows"), size).alias("pages")
    )


def widget_bounds(df: DataFrame, column: str, step: int) -> DataFrame:
    """Range of a column, widened to multiples of ``step``."""
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select(
        numbers.floor_to_step(F.col("lo"), step).alias(f"{column}_min"),
        numbers.ceil_to_step(F.col("hi"), step).cast("bigint").alias(f"{column}_max"),
    )


def _has_no_place() -> Column:
    return F.col("address_lat").isNull() | F.col("address_lon").isNull()


def missing_places(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(_has_no_place()).alias("missing"))


def with_place(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["address_lat", "address_lon"])


def centroid(df: DataFrame) -> DataFrame:
    return with_place(df).agg(F.avg("address_lat").alias("lat"), F.avg("address_lon").alias("lon"))


_CELL = ("cell_lat", "cell_lon")


def clusters(df: DataFrame, cell: float = 0.05, levels: int = 1) -> DataFrame:
    """Points grouped by grid cell, as a map shows them zoomed out, with their mean place and exact median fee.

    Level 0 has cells of ``cell`` degrees, each further one cells of twice the side. Counts and sums of all levels are rolled up
    from the cells of level 0, so the points are aggregated once; only the median returns to them.
    """
    placed = with_place(df).withColumns({
        name: F.floor(F.col(place) / F.lit(cell)) for name, place in zip(_CELL, ("address_lat", "address_lon"))
    })
    finest = placed.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("points"), F.sum("address_lat").alias("lat"), F.sum("address_lon").alias("lon"))
    zoom = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")

    def at_level(rows: DataFrame, *keep: str) -> DataFrame:
        """Each row once a level, in the cell that holds it there."""
        return rows.select(zoom, *_CELL, *keep).withColumns({c: F.expr(f"shiftright({c}, level)") for c in _CELL})

    rolled = at_level(finest, "points", "lat", "lon").groupBy("level", *_CELL).agg(F.sum("points").alias("points"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"))
    fees = grouped_median(at_level(placed, "total_fee"), ["level", *_CELL], "total_fee", "median_fee")
    # both sides have a row a cell, whose number no estimate knows: neither is broadcast
    return rolled.withColumns({c: F.col(c) / F.col("points") for c in ("lat", "lon")}).join(fees.hint("shuffle_hash"), ["level", *_CELL], "left")


def last_update(active: DataFrame) -> DataFrame:
    """Latest activation per segment."""
    return active.groupBy(*SEGMENT).agg(F.max("updated_date").alias("last_update"))


def stale_segments(active: DataFrame, requested: DataFrame, as_of: dt.date, force: bool = False) -> DataFrame:
    """Requested segments that were never loaded, or not on the day ``as_of``."""
    known = requested.join(last_update(active), list(SEGMENT), "left")
    if force:
        return known
    loaded = F.col("last_update")
    return known.where(loaded.isNull() | (loaded.cast("date") != F.lit(as_of)))
