"""Shards of near equal size by longest-processing-time scheduling; groups stay together.

Groups are aggregated before their shuffle, so a group of a third of all rows is one number per task. A group above one
``units``-th of all bytes is scheduled by itself; there are fewer than ``units`` of these at any size of the corpus. Smaller
groups are bundled by hash into ``units`` bundles, each of which is scheduled as one group. The driver thus sorts
at most two ``units`` of sizes, the largest first, and gives each to the least loaded shard through a heap. Rows then
find their shard by two broadcasts of that size, without moving.

The largest shard exceeds the least by no more than the last unit given to it; only a group above a whole share of
a shard makes sizes uneven, as it may not be split. The size of a row is its UTF-8 bytes plus 1. Null and empty texts are
equal. Repeated rows are rows of their own, in one group. Groups are compared by MD5.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casario.llm.frames import numbered
from casario.session import cut_lineage

UNITS = 1 << 16
# Every shard takes this many bundles at least.
LEAST_BUNDLES = 64
FILE_BYTES = 256 << 20

SHARD, SLOT, SIZE, GROUP, BUNDLE = "__llm_shard", "__llm_slot", "__llm_size", "__llm_group", "__llm_bundle"


@dataclass
class Plan:
    """Shards of large groups and of bundles, and the bytes of each shard."""

    groups: DataFrame
    bundles: DataFrame
    loads: list[int]
    units: int


def longest_first(sizes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """(shard of each size, load of each shard); equal sizes go by their place, equal loads to the lower shard."""
    heap = [(0, k) for k in range(shards)]
    out = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        load, shard = heap[0]
        out[at] = shard
        heapq.heapreplace(heap, (load + sizes[at], shard))
    return out, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def _sized(docs: DataFrame, units: int, group: Column | None) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(text if group is None else F.coalesce(group.cast("string"), F.lit("")))
    return docs.withColumns({SIZE: F.octet_length(text).cast("long") + 1, GROUP: digest}).withColumn(
        BUNDLE, (F.conv(F.substring(GROUP, 1, 12), 16, 10).cast("long") % units).cast("int")
    )


def plan(docs: DataFrame, shards: int, units: int = UNITS, group: Column | None = None) -> Plan:
    """Schedules all groups; ``group`` defaults to the text itself."""
    if shards < 1:
        raise ValueError("at least one shard")
    units = max(units, LEAST_BUNDLES * shards)
    spark = docs.sparkSession
    sizes = cut_lineage(_sized(docs, units, group).groupBy(GROUP, BUNDLE).agg(F.sum(SIZE).alias("bytes")))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    alone = F.col("bytes") > total // units
    small = sizes.where(~alone).groupBy(BUNDLE).agg(F.sum("bytes").alias("bytes"))
    # fewer than ``units`` rows of each kind
    found = sizes.where(alone).select(GROUP, F.lit(None).cast("int").alias(BUNDLE), "bytes").unionByName(
        small.select(F.lit(None).cast("string").alias(GROUP), BUNDLE, "bytes")
    ).orderBy(GROUP, BUNDLE).toArrow()
    placed, loads = longest_first(found.column("bytes").to_pylist(), shards)
    table = pa.table({GROUP: found.column(GROUP).cast(pa.string()), BUNDLE: found.column(BUNDLE), SHARD: pa.array(placed, pa.int32())})
    units_of = cut_lineage(spark.createDataFrame(table))
    return Plan(
        units_of.where(F.col(GROUP).isNotNull()).select(GROUP, F.col(SHARD).alias("__llm_own")),
        units_of.where(F.col(BUNDLE).isNotNull()).select(BUNDLE, F.col(SHARD).alias("__llm_shared")), loads, units,
    )


def with_shard(docs: DataFrame, planned: Plan, group: Column | None = None) -> DataFrame:
    """``docs`` with ``__llm_shard`` and ``__llm_size``; no row moves."""
    sized = _sized(docs, planned.units, group)
    joined = sized.join(F.broadcast(planned.groups), GROUP, "left").join(F.broadcast(planned.bundles), BUNDLE, "left")
    return joined.select(*docs.columns, SIZE, F.coalesce("__llm_own", "__llm_shared").alias(SHARD))


def with_slot(sharded: DataFrame) -> DataFrame:
    """Adds ``__llm_slot``, gapless from 0 in each shard. The columns are written once; leave the text out where it isn't needed."""
    return numbered(sharded, SHARD, SLOT)


def write_shards(docs: DataFrame, path: str, shards: int, group: Column | None = None) -> list[int]:
    """Writes ``docs`` to ``path/shard=k``, files of some 256 MB of text; returns the bytes of each shard."""
    planned = plan(docs, shards, group=group)
    files = max(1, -(-max(planned.loads) // FILE_BYTES))
    rows = with_shard(docs, planned, group).withColumn("shard", F.col(SHARD))
    # the file is drawn by row, so that a group of a third of all rows fills many files of its shard
    spread = rows.withColumn("__llm_piece", F.pmod(F.xxhash64(*docs.columns), F.lit(files)))
    spread.repartition(shards * files, "shard", "__llm_piece").drop(SIZE, SHARD, "__llm_piece").write.partitionBy("shard").parquet(path)
    return planned.loads
