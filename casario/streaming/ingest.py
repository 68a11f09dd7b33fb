"""Landed files as a stream: each trigger merges what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from casario.plans.refresh import merge_into, observe
from casario.schemas import PAGE
from casario.session import cut_lineage, job_scratch
from casario.sources.pages import failed
from casario.sources.tables import Store


def page_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def keep_fresh(path: str, key: str, date: str, run: str = "first") -> Callable[[DataFrame, int], None]:
    """A merge that keeps one observation of each key and day under ``path``, however late it arrives.

    Rows lie by run, trigger and day (``run``, ``trigger``, ``_day``). A trigger reads back only the days it brings, so no state
    grows in memory and no row is too old to be compared. ``run`` names the checkpoint: triggers are numbered from 0 again
    with a new one, which then needs a name of its own. A replayed trigger compares with all others and replaces itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        once = cut_lineage(batch.withColumn("_day", F.col(date).cast("date")).dropDuplicates([key, "_day"]))
        days = [r[0] for r in once.select("_day").distinct().collect()]
        kind = batch.schema[key].dataType.simpleString()
        stored = read_stored(session, path, f"`{key}` {kind}, run string, trigger int, _day date")
        known = stored.where(
            ((F.col("run") != run) | (F.col("trigger") != number)) & (F.col("_day").isin([d for d in days if d]) | F.col("_day").isNull())
        ).select(F.col(key).alias("_known"), F.col("_day").alias("_on"))
        fresh = once.join(known, F.col(key).eqNullSafe(F.col("_known")) & F.col("_day").eqNullSafe(F.col("_on")), "left_anti")
        fresh.repartitionByRange("_day", key).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_day").parquet(
            f"{path}/run={run}/trigger={number}"
        )

    return merge


def read_stored(session: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows under a folder; none while nothing was written there."""
    try:
        return session.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return session.createDataFrame([], schema)


def merge_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``merge`` with the rows and number of each trigger until all present files are taken.

    The merge is idempotent, so a batch replayed after a failure changes nothing.
    """
    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_pages(
    spark: SparkSession, path: str, requests: DataFrame, store: Store, checkpoint: str, stations: DataFrame | None = None,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """New page files to merged listings; rejects and failed pages are kept by trigger in the store's folder.

    A failed page cuts its request in all later triggers, as it does within one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        # what a trigger writes for itself goes with it
        with job_scratch(batch.sparkSession):
            take(batch, number)

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        landed = cut_lineage(batch, compression="zstd")
        failures = f"{store.root}/page_failures"
        landed.where(failed(landed)).select("origin", "request_id", "page").write.mode("overwrite").parquet(f"{failures}/trigger={number}")
        known = session.read.schema("origin string, request_id string, page int, trigger int").parquet(failures)
        usable, rejects = observe(landed, requests, stations, known.where(F.col("trigger") <= number))
        rejects.write.mode("overwrite").parquet(f"{store.root}/rejects/trigger={number}")
        merge_into(store, usable)

    return merge_stream(page_stream(spark, path, files_per_trigger), merge, checkpoint)
