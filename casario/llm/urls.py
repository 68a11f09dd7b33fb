"""URL filter by dated lists: which captures were blocked when they were fetched.

A list is a log of dated entries (pattern, action, at): ``add`` puts a pattern on the list, ``remove`` takes it off.
Patterns are a host, which covers its sub-domains, or a host with a path, which covers all below that path.
The log of a pattern becomes disjoint validity intervals. Time is cut into blocks, and the interval that is open where a
block begins is carried into it, so the as-of join is an equi-join on pattern and block: a capture meets the carried interval
and those that begin in its block, not all intervals of its pattern. At most one of them holds its time.

Null or unparsable urls and null times match nothing. Rows of the log with a null pattern, time or
unknown action are ignored. Of entries of one pattern and time, ``add`` wins. Repeated captures each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casario.session import cut_lineage

# seconds of a block of time: a pattern has one carried interval a block, and meets the entries of one block at once
BLOCK = 3600

def host_of(url: Column) -> Column:
    """Lower-case host without user, port, final dot; empty if there is none."""
    host = F.regexp_extract(url, r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def path_of(url: Column) -> Column:
    """Path without query, fragment and empty segments, like ``a/b``."""
    path = F.regexp_extract(url, r"(?i)^\s*[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")


def patterns_of(url: Column) -> Column:
    """Every pattern that covers a url: its host and parent domains, and the host with each leading part of the path."""
    host, path = host_of(url), path_of(url)
    labels, segments = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    below = F.transform(
        F.sequence(F.lit(1), F.size(segments)), lambda n: F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), n), "/"))
    )
    every = F.when(path == "", domains).otherwise(F.concat(domains, below))
    return F.when(host != "", F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def validity(log: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) during which a pattern is listed; an open end is null.

    Entries of one pattern and time collapse before the window, so a pattern has as many rows
    as times at which it changed.
    """
    acts = (
        log.where(F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
        .groupBy("pattern", "at").agg(F.max(F.col("action") == "add").alias("listed"))
    )
    order = Window.partitionBy("pattern").orderBy("at")
    changes = acts.withColumn("before", F.lag("listed", 1, False).over(order)).where(F.col("listed") != F.col("before"))
    return (
        changes.withColumn("valid_to", F.lead("at").over(order)).where("listed")
        .select("pattern", F.col("at").alias("valid_from"), "valid_to")
    )


def block_of(at: Column, width: int) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / F.lit(width)).cast("long")


def open_by_block(intervals: DataFrame, asked: DataFrame, width: int = BLOCK) -> DataFrame:
    """(pattern, block, valid_from, valid_to): the intervals that begin in a block, and in each block of ``asked`` the one
    that was open when it began.

    ``asked`` holds distinct (pattern, block). The window runs over blocks, not over captures or entries.
    """
    begun = intervals.select("pattern", block_of(F.col("valid_from"), width).alias("block"), "valid_from", "valid_to")
    none = F.lit(None).cast(intervals.select(F.struct("valid_from", "valid_to")).dtypes[0][1])
    marks = begun.groupBy("pattern", "block").agg(F.max_by(F.struct("valid_from", "valid_to"), "valid_from").alias("last")).select(
        "pattern", "block", "last", F.lit(False).alias("asked")
    ).unionByName(asked.select("pattern", "block", none.alias("last"), F.lit(True).alias("asked")))
    each = marks.groupBy("pattern", "block").agg(F.any_value("last", True).alias("last"), F.max("asked").alias("asked"))
    before = Window.partitionBy("pattern").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.withColumn("open", F.last("last", True).over(before)).where("asked AND open IS NOT NULL")
    lasting = F.col("open.valid_to").isNull() | (block_of(F.col("open.valid_to"), width) >= F.col("block"))
    return begun.unionByName(carried.where(lasting).select("pattern", "block", "open.valid_from", "open.valid_to"))


def blocked_captures(
    captures: DataFrame, log: DataFrame, url: str = "url", at: str = "fetched_at", key: str = "page_id", width: int = BLOCK
) -> DataFrame:
    """(key, url, at, blocked, n_matches, pattern, listed_since) of every capture.

    ``pattern`` is the longest matching one (by characters, then by text) and ``listed_since`` the start
    of its interval. Equal (url, time) are evaluated once, so a url captured over and over costs one row.
    """
    wanted = captures.select(F.col(key).alias("__llm_id"), F.col(url).alias("__llm_url"), F.col(at).alias("__llm_at"))
    asked = wanted.select("__llm_url", "__llm_at").distinct()
    keyed = asked.where(F.col("__llm_at").isNotNull()).select(
        "*", F.explode(patterns_of(F.col("__llm_url"))).alias("pattern"), block_of(F.col("__llm_at"), width).alias("block")
    )
    intervals = cut_lineage(validity(log))
    # distinct first, so that captures of one host are few rows by then
    blocks = keyed.select("pattern", "block").distinct().join(intervals.select("pattern").distinct(), "pattern", "left_semi")
    # written, so that its size decides the join, which then may split a hot key
    pieces = cut_lineage(open_by_block(intervals, blocks, width))
    hits = keyed.join(pieces, ["pattern", "block"]).where(
        (F.col("__llm_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__llm_at") < F.col("valid_to")))
    )
    best = F.max(F.struct(F.length("pattern"), "pattern", "valid_from"))
    verdicts = hits.groupBy("__llm_url", "__llm_at").agg(F.count("*").alias("n_matches"), best.alias("best"))
    # renamed, as both sides come from the same columns
    verdicts = verdicts.withColumnsRenamed({"__llm_url": "__llm_same_url", "__llm_at": "__llm_same_at"})
    same = F.col("__llm_url").eqNullSafe(F.col("__llm_same_url")) & F.col("__llm_at").eqNullSafe(F.col("__llm_same_at"))
    return wanted.join(verdicts, same, "left").select(
        F.col("__llm_id").alias(key), F.col("__llm_url").alias(url), F.col("__llm_at").alias(at),
        F.col("n_matches").isNotNull().alias("blocked"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("listed_since"),
    )
