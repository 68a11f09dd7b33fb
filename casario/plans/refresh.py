"""The refresh job: stale segments in, listing table, active set and predictions out."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casario.operators import clean, features, nearest, serve, upsert
from casario.schemas import LISTING_TYPES, SEGMENT
from casario.session import cut_lineage
from casario.sources import pages as page_source
from casario.sources.tables import Store


def moment(as_of: dt.datetime) -> Column:
    """A UTC wall-clock time as a literal, whatever zone this process runs in."""
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp")


def observe(
    pages: DataFrame, requests: DataFrame, stations: DataFrame | None = None, failures: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Landed pages to (usable listings with their station, rejects). Rejects are records and whole pages, with reasons.

    ``failures`` are failed pages (origin, request_id, page) of earlier batches.
    """
    good = page_source.before_first_failure(pages, known=failures)
    # usable rows, rejects and the station search all read it: parse the pages once; most of it is text
    cleaned = clean.clean_listings(page_source.stamp(page_source.records(good), requests))
    read = [c for c in cleaned.columns if c in LISTING_TYPES or c in ("seq", "origin", "reject_reasons")]
    cleaned = cut_lineage(cleaned.select(*read), compression="zstd")
    usable = clean.accepted(cleaned, keep=("seq",))
    if stations is not None:
        # folding and activation read it again; without stations it is a selection of what was written
        usable = cut_lineage(nearest.attach_nearest_station(usable, stations, order="url"), compression="zstd")
    else:
        usable = usable.withColumns(
            {c: F.lit(None).cast(t) for c, t in (
                ("linha", "string"), ("estacao", "string"), ("lat_metro", "double"),
                ("lon_metro", "double"), ("distance", "double"))}
        )
    return usable, clean.rejected(cleaned).unionByName(page_source.rejected_pages(pages, requests))


def merge_into(store: Store, batch: DataFrame, force: bool = False, **columns) -> None:
    """Folds a batch and merges it into the touched buckets of the listing table.

    Stored rows are joined where they lie. The batch, which is read several times, is shuffled once, to its buckets, and folded there.
    """
    touched = store.touched_buckets(batch)
    if not touched:
        return
    folded = upsert.fold_batch(batch, key=store.key, force=force, partitions=store.buckets, **columns)
    stored = store.read("listing").where(F.col("url_bucket").isin(touched)).drop("url_bucket")
    columns.pop("seq", None)
    merged = upsert.merge(stored, folded, key=store.key, force=force, **columns)
    if {"created", "updated"} <= set(merged.columns):
        merged = upsert.stamp_audit(merged)
    store.replace_partitions("listing", store.with_bucket(merged.drop("_op")), placed=True)


def activate(store: Store, segments: DataFrame, batch: DataFrame, as_of: dt.datetime) -> None:
    """Replaces the given segments of the active set by the urls of the batch.

    New rows are written before old ones are dropped: a job that dies in between leaves no segment empty.
    """
    rows = batch.select("url", *SEGMENT, "seq").withColumn("updated_date", moment(as_of))
    surviving = upsert.without_segments(store.read("active"), segments)
    fresh = cut_lineage(upsert.new_active(rows, surviving))
    store.replace_partitions("active", fresh)
    store.clear_segments(segments.select(*SEGMENT).join(fresh.select(*SEGMENT).distinct(), list(SEGMENT), "left_anti"))


def score_active(store: Store, model: PipelineModel, encoding: DataFrame, segments: DataFrame, as_of: dt.datetime) -> bool:
    """Predicts the active listings of the segments and stores the result; False if there are none."""
    listings = store.read("listing")
    wanted = serve.active_listings(listings, store.read("active")).join(
        segments.select(*SEGMENT), list(SEGMENT), "left_semi"
    )
    frame = cut_lineage(features.feature_frame(wanted, encoding, moment(as_of)))
    if frame.isEmpty():
        return False
    predictions = model.transform(frame).select("url", "prediction")
    touched = store.touched_buckets(predictions)
    part = listings.where(F.col("url_bucket").isin(touched))
    store.replace_partitions("listing", upsert.write_back(part, predictions), placed=True)
    return True


def refresh(
    store: Store,
    pages: DataFrame,
    requests: DataFrame,
    as_of: dt.datetime,
    stations: DataFrame | None = None,
    model: PipelineModel | None = None,
    encoding: DataFrame | None = None,
    force: bool = False,
) -> DataFrame:
    """One pass of the daily cycle over all requested segments; returns the rejects.

    ``requests`` holds one row per (origin, request_id) with the search context. Segments
    already loaded on the day of ``as_of`` are skipped unless forced.
    """
    asked = requests.withColumnRenamed("locationId", "location_id").select(*SEGMENT).distinct()
    stale = cut_lineage(serve.stale_segments(store.read("active"), asked, as_of.date(), force).select(*SEGMENT))
    due = requests.join(
        stale.withColumnRenamed("location_id", "locationId"), ["business_type", "listing_type", "locationId"], "left_semi"
    )
    batch, rejects = observe(pages, due, stations)
    merge_into(store, batch, force)
    activate(store, stale, batch, as_of)
    if model is not None and encoding is not None:
        score_active(store, model, encoding, stale, as_of)
    return rejects


def current(store: Store, business_type: str, listing_type: str, location_id: str) -> DataFrame:
    """Active listings of a segment. The segment is that of the listing, as first seen."""
    segment = serve.in_segment(store.read("listing"), business_type, listing_type, location_id)
    return serve.active_listings(segment, store.read("active"))
