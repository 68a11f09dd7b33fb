"""Order statistics, row positions and previous-row lookups that survive hot keys.

Nothing here sorts an unbounded group inside one task: groups are first cut into cells
or blocks whose size has a bound, and only counts travel between the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from casario.session import cut_lineage

# Cells of the value axis: 64 per octave, each cut into 4096.
COARSE_CELLS = 64
FINE_CELLS = 4096
# A key with more rows than this is not windowed as a whole.
HOT_ROWS = 1_000_000


def _not_null(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def grouped_median(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Exact interpolated median of ``value`` per group; null values and null groups are left out.

    Equal values of a group are counted first. A fixed, monotone cutting of the value
    axis then locates the cell holding each middle rank from per-cell counts, and only
    that cell's distinct values are ordered. A group of any size is thus spread over
    many tasks, unless its distinct values crowd into one cell.
    """
    counted = (
        df.where(_not_null([*group, value]) & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*group, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # octave and place within it, like the bits of a double: as fine for tiny values as for large ones
    size = F.abs(F.col("_v"))
    octave = F.floor(F.log2(size))
    place = octave + size / F.pow(F.lit(2.0), octave) + F.lit(1100.0)
    position = F.when(size > 0, F.signum("_v") * place * F.lit(float(COARSE_CELLS))).otherwise(0.0)
    cell = F.floor(position).cast("bigint")
    fine = F.floor((position - F.floor(position)) * F.lit(float(FINE_CELLS))).cast("bigint")
    counted = counted.withColumns({"_cell": cell, "_fine": fine})
    cells = counted.groupBy(*group, "_cell", "_fine").agg(F.sum("_n").alias("_n"))
    coarse = cells.groupBy(*group, "_cell").agg(F.sum("_n").alias("_n"))

    # COARSE_CELLS per octave: some thousands for values of any usual spread, 270,000 over the double range
    ordered = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    ranked = coarse.withColumns(
        {"_before": F.sum("_n").over(ordered) - F.col("_n"), "_total": F.sum("_n").over(whole)}
    ).withColumns(
        {
            "_k1": F.floor((F.col("_total") - 1) / 2).cast("bigint"),
            "_k2": F.floor(F.col("_total") / 2).cast("bigint"),
        }
    )

    def holds(rank: str) -> Column:
        return (F.col("_before") <= F.col(rank)) & (F.col(rank) < F.col("_before") + F.col("_n"))

    middle = ranked.where(holds("_k1") | holds("_k2")).select(
        *group, "_cell", F.col("_before").alias("_base"), "_k1", "_k2"
    )
    # The side with every cell, or every value, is never broadcast: sizes guessed through an explode or an aggregate are far
    # too small. One row or two a group are looked up in it where it lies.
    # at most FINE_CELLS rows per window
    inner = Window.partitionBy(*group, "_cell").orderBy("_fine").rowsBetween(Window.unboundedPreceding, 0)
    narrowed = (
        cells.join(middle.hint("shuffle_hash"), [*group, "_cell"])
        .withColumn("_before", F.col("_base") + F.sum("_n").over(inner) - F.col("_n"))
        .where(holds("_k1") | holds("_k2"))
        .select(*group, "_cell", "_fine", F.col("_before").alias("_base"), "_k1", "_k2")
    )
    # the distinct values of one fine cell, which agree to a part in COARSE_CELLS * FINE_CELLS
    last = Window.partitionBy(*group, "_cell", "_fine").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counted.join(narrowed.hint("shuffle_hash"), [*group, "_cell", "_fine"])
        .withColumn("_before", F.col("_base") + F.sum("_n").over(last) - F.col("_n"))
        .groupBy(*group)
        .agg(
            (
                (F.max(F.when(holds("_k1"), F.col("_v"))) + F.max(F.when(holds("_k2"), F.col("_v")))) / F.lit(2.0)
            ).alias(name)
        )
    )


def hot_keys(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows. There are fewer than total/rows of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(*keys)


def previous_value(
    df: DataFrame, key: str, seq: str, value: str, name: str, hot_rows: int = HOT_ROWS, block: int = 1_000_000
) -> DataFrame:
    """Adds ``name`` (``value`` of the row before, by ``seq``) and ``name_first`` per key.

    ``seq`` is a whole number, unique within the key. Rows of a hot key are windowed in
    blocks of ``block`` consecutive numbers; the value carried over a block's edge comes
    from one summary row per block.
    """
    hot = hot_keys(df.select(key), [key], hot_rows).withColumn("_hot", F.lit(True))
    # bounded: a key is hot only above hot_rows rows, so 10^12 rows allow 10^6 keys
    blocked = (
        df.join(F.broadcast(hot), key, "left")
        .withColumn("_block", F.when(F.col("_hot"), F.floor(F.col(seq) / F.lit(block))).otherwise(F.lit(0)).cast("bigint"))
    )
    within = Window.partitionBy(key, "_block").orderBy(seq)
    inner = blocked.withColumns(
        {
            "_prev": F.lag(F.struct(F.col(value).alias("v"))).over(within),
        }
    )
    edges = (
        blocked.where("_hot")
        .groupBy(key, "_block")
        .agg(F.max(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))).alias("_last"))
        .withColumn("_edge", F.lag("_last").over(Window.partitionBy(key).orderBy("_block")))
        .where(F.col("_edge").isNotNull())
        .select(key, "_block", "_edge")
    )
    joined = inner.join(edges, [key, "_block"], "left")
    return joined.withColumns(
        {
            name: F.when(F.col("_prev").isNotNull(), F.col("_prev.v")).otherwise(F.col("_edge.v")),
            f"{name}_first": F.col("_prev").isNull() & F.col("_edge").isNull(),
        }
    ).drop("_hot", "_block", "_prev", "_edge")


def keys_at(
    df: DataFrame, order: list[Column], keys: list[str], positions: list[int], as_text: bool = False
) -> dict[int, Row]:
    """The key rows at the given 0-based positions of the sorted order.

    ``as_text`` returns the keys as text, which casts back exactly and does not depend on
    the time zone of this process.

    Only the key columns are sorted (range partitioned). Sorted rows are written once,
    so partition counts and positions refer to the same partitions; a handful of rows
    and one count per partition reach the driver.
    """
    sorted_keys = cut_lineage(
        df.select(*keys).orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    counts = sorted_keys.groupBy(part.alias("p")).count().orderBy("p").collect()
    wanted, start = {}, 0
    for row in counts:
        for pos in positions:
            if start <= pos < start + row["count"]:
                wanted[(row["p"] << 33) + (pos - start)] = pos
        start += row["count"]
    if not wanted:
        return {}
    shown = [F.col(c).cast("string").alias(c) if as_text else F.col(c) for c in keys]
    rows = sorted_keys.where(F.col("_at").isin(list(wanted))).select("_at", *shown).collect()
    return {wanted[r["_at"]]: r for r in rows}


def block_starts(total: int, k: int) -> list[int]:
    """First positions of k contiguous blocks; the first ``total % k`` are one longer."""
    return [j * (total // k) + min(j, total % k) for j in range(k)]


def with_contiguous_folds(df: DataFrame, keys: list[str], k: int = 5, name: str = "fold") -> DataFrame:
    """Adds a 1-based fold: k contiguous blocks of rows in the order of ``keys`` (unique, not null)."""
    total = df.count()
    starts = block_starts(total, k)[1:]
    found = keys_at(df, [F.col(c) for c in keys], keys, starts, as_text=True)
    types = dict(df.dtypes)
    here = F.struct(*[F.col(c) for c in keys])
    fold = F.lit(1)
    for pos in starts:
        if pos in found:
            cut = F.struct(*[F.lit(found[pos][c]).cast(types[c]).alias(c) for c in keys])
            fold = fold + F.when(here >= cut, 1).otherwise(0)
    return df.withColumn(name, fold.cast("int"))
