"""Change-gated merge of observed listings into the keyed listing table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casario.operators.ranks import HOT_ROWS, hot_keys, previous_value
from casario.schemas import ACTIVE_TYPES, IMMUTABLE, MUTABLE, SEGMENT
from casario.session import cut_lineage


def gate_opens(old: Column, new: Column, force: bool = False) -> Column:
    """Update when forced, when either date is missing, or when the calendar day differs."""
    if force:
        return F.lit(True)
    return old.isNull() | new.isNull() | (old.cast("date") != new.cast("date"))


def mark_applied(
    batch: DataFrame, key: str = "url", seq: str = "seq", date: str = "updated_date", force: bool = False, **hot
) -> DataFrame:
    """Adds ``applied``: whether the row overwrites the state its predecessors left.

    The state's day always equals the last observed day (an unapplied row has the same
    day), so the gate only needs the previous row. ``seq`` is unique per key.
    """
    seen = previous_value(batch, key, seq, date, "_before", **hot)
    return seen.withColumn(
        "applied", F.col("_before_first") | gate_opens(F.col("_before"), F.col(date), force)
    ).drop("_before", "_before_first")


def fold_batch(
    batch: DataFrame,
    key: str = "url",
    seq: str = "seq",
    date: str = "updated_date",
    immutable: tuple[str, ...] = IMMUTABLE,
    mutable: tuple[str, ...] = MUTABLE,
    force: bool = False,
    partitions: int | None = None,
    hot_rows: int = HOT_ROWS,
    **hot,
) -> DataFrame:
    """One row per key: first-seen immutable columns, last applied mutable ones.

    ``_runs`` counts the applied rows; more than one means the batch itself changed day,
    so the fold wins over any stored row.

    Whole rows are shuffled once, to ``partitions`` by key if given. Keys above ``hot_rows`` rows are few by counting: their first and
    last applied row are found in key, order and date alone, and only these two rows of them are shuffled.
    """
    mutable = tuple(c for c in mutable if c in batch.columns)
    immutable = tuple(c for c in immutable if c in batch.columns)
    order, rows = F.col(seq), batch
    narrow = batch.select(key, seq, date)
    often = cut_lineage(hot_keys(narrow, [key], hot_rows).select(F.col(key).alias("_often")))
    crowded = not often.isEmpty()
    if crowded:
        of_often = narrow.join(F.broadcast(often), F.col(key).eqNullSafe(F.col("_often")), "left_semi")
        marked = mark_applied(of_often, key, seq, date, force, hot_rows=hot_rows, **hot)
        ends = marked.groupBy(F.col(key).alias("_often")).agg(
            F.min(order).alias("_from"), F.max(F.when(F.col("applied"), order)).alias("_to"), F.count_if("applied").alias("_hot_runs")
        )
        rows = batch.join(F.broadcast(ends), F.col(key).eqNullSafe(F.col("_often")), "left").where(
            F.col("_hot_runs").isNull() | order.isin(F.col("_from"), F.col("_to"))
        ).drop("_often", "_from")
    if partitions:
        rows = rows.repartition(partitions, key)
    before = F.lag(F.struct(F.col(date).alias("v"))).over(Window.partitionBy(key).orderBy(seq))
    rows = rows.withColumn("_before", before)
    applied = F.col("_before").isNull() | gate_opens(F.col("_before.v"), F.col(date), force)
    if crowded:
        applied = F.when(F.col("_hot_runs").isNull(), applied).otherwise(order.eqNullSafe(F.col("_to")))
    runs = F.count_if(applied)
    folded = rows.groupBy(key).agg(
        F.min_by(F.struct(*immutable), order).alias("_first") if immutable else F.first(F.lit(1)).alias("_first"),
        F.max_by(F.struct(*mutable), F.when(applied, order)).alias("_last"),
        (F.coalesce(F.max("_hot_runs"), runs) if crowded else runs).alias("_runs"),
    )
    return folded.select(
        key, *[F.col(f"_first.{c}").alias(c) for c in immutable], *[F.col(f"_last.{c}").alias(c) for c in mutable], "_runs"
    )


def merge(
    stored: DataFrame,
    folded: DataFrame,
    key: str = "url",
    date: str = "updated_date",
    immutable: tuple[str, ...] = IMMUTABLE,
    mutable: tuple[str, ...] = MUTABLE,
    force: bool = False,
) -> DataFrame:
    """Stored table after the batch; ``_op`` says insert, update or keep.

    The key is unique on both sides, so neither side of the join can be skewed.
    """
    old, new = stored.alias("old"), folded.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    is_new = F.col(f"old.{key}").isNull()
    arrived = F.col(f"new.{key}").isNotNull()
    opens = (F.col("new._runs") > 1) | gate_opens(F.col(f"old.{date}"), F.col(f"new.{date}"), force)
    op = F.when(is_new, "insert").when(arrived & opens, "update").otherwise("keep")
    staged = joined.withColumn("_op", op)
    out = [F.coalesce(F.col(f"old.{key}"), F.col(f"new.{key}")).alias(key)]
    for c in stored.columns:
        if c == key:
            continue
        in_batch = c in folded.columns
        if c in mutable and in_batch:
            value = F.when(F.col("_op") == "keep", F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        elif c in immutable and in_batch:
            # by row, not by column: a stored null stays as first seen
            value = F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        else:
            value = F.col(f"old.{c}")
        out.append(value.alias(c))
    return staged.select(*out, "_op")


def stamp_audit(merged: DataFrame) -> DataFrame:
    """Fills the audit columns: ``created`` once, ``updated`` on every change."""
    now = F.current_timestamp()
    return merged.withColumns(
        {
            "created": F.coalesce(F.col("created"), now),
            "updated": F.when(F.col("_op") == "keep", F.coalesce(F.col("updated"), now)).otherwise(now),
        }
    )


def without_segments(active: DataFrame, segments: DataFrame) -> DataFrame:
    """Active rows outside the given segments."""
    return active.join(segments.select(*SEGMENT), list(SEGMENT), "left_anti")


def new_active(batch: DataFrame, surviving: DataFrame) -> DataFrame:
    """One active row per url of the batch that is not active anywhere yet (lowest ``seq`` decides)."""
    names = [c for c in ACTIVE_TYPES if c != "url"]
    first = batch.groupBy("url").agg(F.min_by(F.struct(*names), "seq").alias("_a")).select("url", "_a.*")
    return first.join(surviving.select("url"), "url", "left_anti")


def replace_segments(active: DataFrame, segments: DataFrame, batch: DataFrame) -> DataFrame:
    """Active set after the given segments were cleared and the batch activated."""
    surviving = without_segments(active, segments)
    return surviving.unionByName(new_active(batch, surviving).select(*surviving.columns))


def orphans(active: DataFrame, listings: DataFrame) -> DataFrame:
    """Active rows without a listing; must be empty."""
    return active.join(listings.select("url"), "url", "left_anti")


def write_back(listings: DataFrame, predictions: DataFrame, key: str = "url") -> DataFrame:
    """Puts fresh predictions into ``total_fee_predict``; other rows keep theirs."""
    fresh = predictions.select(key, F.col("prediction").alias("_fresh"))
    return (
        listings.join(fresh, key, "left")
        .withColumn("total_fee_predict", F.coalesce(F.col("_fresh"), F.col("total_fee_predict")))
        .drop("_fresh")
        .select(*listings.columns)
    )
