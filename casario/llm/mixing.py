"""Mixing sources to target weights by temperature, as whole passes and permuted blocks within a token budget.

Source shares are raised to an exponent between 1 (as they are) and 0 (all alike). The exponent is the largest that
reaches the target entropy, unless that repeats some source more often than allowed; then it is the
smallest that does not. It is found by cutting the interval again and again; each cut is one aggregation
over the source table that evaluates many exponents at once.

A source's budget is its weight times the total budget: whole passes over its documents, then part of a pass.
Documents fall into hash blocks, at most ``MOST_BLOCKS`` a source. A part of a pass takes blocks in a permuted order; the
block in which the budget ends is cut in the order of document hashes, after the document that meets it.

Tokens are words between ASCII white space. Null texts have none. A null source is a source of its own. Sources without
tokens have weight 0 and no rows. Repeated rows are repeated documents; ties are ordered by doc_id, tokens and a text hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casario.session import cut_lineage

MOST_BLOCKS = 256
BLOCK_TOKENS = 20_000
SPOT_BITS, CELLS = 52, 4096
POINTS, ROUNDS = 32, 6
# Above this many plan rows (sources times blocks) the plan is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 100_000

ADDED = ("n_tokens", "weight", "epoch", "block", "place")
SOURCE, TOKENS, ORDER, SPOT = "__llm_source", "__llm_tokens", "__llm_order", "__llm_spot"


def n_tokens(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def _hash(*parts: Column) -> Column:
    """``SPOT_BITS`` of an MD5, which every SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def placed(docs: DataFrame) -> DataFrame:
    """Adds source key, tokens, spot (a hash that orders documents) and tie order."""
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    spot = _hash(F.lit("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return docs.withColumns({SOURCE: source, TOKENS: n_tokens(F.col("text")), SPOT: spot}).withColumn(
        ORDER, F.struct(SPOT, "doc_id", TOKENS, F.xxhash64("text"))
    )


def _evaluated(sources: DataFrame, low: float, high: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy, greatest weight over share) at even exponents from ``low`` to ``high``."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(POINTS)), lambda k: F.lit(low) + k * F.lit((high - low) / POINTS))
    terms = sources.select("p", F.explode(grid).alias("a")).withColumn("t", F.exp(F.col("a") * F.ln("p")))
    rows = terms.groupBy("a").agg(
        F.sum("t").alias("z"), F.sum(F.col("t") * F.col("a") * F.ln("p")).alias("s"), F.max(F.col("t") / F.col("p")).alias("m")
    ).orderBy("a").collect()
    return [(r["a"], math.log(r["z"]) - r["s"] / r["z"], r["m"] / r["z"]) for r in rows]


def _edge(sources: DataFrame, holds, low: float = 0.0, high: float = 1.0) -> tuple[float, float]:
    """The interval in which ``holds`` of (entropy, ratio) turns from true, at ``low``, to false."""
    for _ in range(ROUNDS):
        points = _evaluated(sources, low, high)
        true = [a for a, entropy, ratio in points if holds(entropy, ratio)]
        false = [a for a, entropy, ratio in points if not holds(entropy, ratio)]
        if not true:
            return low, low
        if not false:
            return high, high
        low, high = max(true), min(false)
    return low, high


def exponent(sources: DataFrame, repeats_at_share: float, entropy_share: float, most_repeats: float) -> float:
    """Exponent for sources with shares ``p``, rounded to six places.

    ``repeats_at_share`` is the budget over all tokens: a source of weight equal to its share is seen so often.
    """
    target = entropy_share * math.log(max(sources.count(), 1))
    reach, _ = _edge(sources, lambda entropy, _: entropy >= target - 1e-12)
    # repetition falls as the exponent grows, so this turns from true to false at the smallest allowed exponent
    _, allowed = _edge(sources, lambda _, ratio: ratio * repeats_at_share > most_repeats + 1e-12)
    return round(max(reach, allowed), 6)


def plan(docs: DataFrame, budget_tokens: int | None = None, entropy_share: float = 0.97, most_repeats: float = 4.0) -> tuple[DataFrame, int]:
    """((source, block) rows with passes and place, number of rows at most) for documents from :func:`placed`.

    Without a budget the mixture has as many tokens as the documents. A budget above ``most_repeats`` times these is an error.
    """
    narrow = cut_lineage(docs.select(SOURCE, TOKENS, ORDER))
    totals = cut_lineage(narrow.groupBy(SOURCE).agg(F.sum(TOKENS).alias("tokens")).where("tokens > 0"))
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget_tokens is None else budget_tokens
    if budget > most_repeats * total:
        raise ValueError(f"a budget of {budget} tokens repeats {total} tokens more than {most_repeats} times")
    sources = totals.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    power = exponent(sources, budget / total, entropy_share, most_repeats) if total else 1.0
    scale = sources.agg(F.sum(F.exp(F.lit(power) * F.ln("p")))).first()[0] or 1.0
    weighted = sources.withColumn("weight", F.exp(F.lit(power) * F.ln("p")) / F.lit(scale)).withColumns({
        "budget": F.floor(F.col("weight") * F.lit(float(budget))),
        "blocks": F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int"),
    }).withColumns({
        "passes": F.floor(F.col("budget") / F.col("tokens")), "rest": F.col("budget") % F.col("tokens")
    })
    each = narrow.join(weighted, SOURCE).withColumn("block", (F.col(f"{ORDER}.{SPOT}") % F.col("blocks")).cast("int"))
    blocks = each.groupBy(SOURCE, "block").agg(
        F.sum(TOKENS).alias("block_tokens"), *(F.any_value(c).alias(c) for c in ("weight", "passes", "rest", "blocks"))
    ).withColumn("shuffle", _hash(F.lit("block"), F.col(SOURCE), F.col("block").cast("string")))
    # at most MOST_BLOCKS rows a source
    permuted = Window.partitionBy(SOURCE).orderBy("shuffle", "block")
    before = F.sum("block_tokens").over(permuted.rowsBetween(Window.unboundedPreceding, -1))
    settled = cut_lineage(blocks.withColumns({
        "place": F.row_number().over(permuted), "left": F.col("rest") - F.coalesce(before, F.lit(0)),
    }))
    ends = settled.where((F.col("left") > 0) & (F.col("left") < F.col("block_tokens")))
    # one block of each source is cut: first by cells of its order, of which there are CELLS, then inside one cell
    inside = (
        narrow.join(ends.select(SOURCE, "block", "blocks", "left"), SOURCE)
        .where(F.col(f"{ORDER}.{SPOT}") % F.col("blocks") == F.col("block"))
        .withColumn("cell", F.floor(F.col(f"{ORDER}.{SPOT}") / F.lit((1 << SPOT_BITS) // CELLS)))
    )
    by_cell = Window.partitionBy(SOURCE).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = inside.groupBy(SOURCE, "block", "left", "cell").agg(F.sum(TOKENS).alias("size"), F.max(ORDER).alias("last")).withColumn(
        "start", F.coalesce(F.sum("size").over(by_cell), F.lit(0))
    )
    whole = F.col("start") + F.col("size") < F.col("left")
    edge = cells.where(~whole & (F.col("start") < F.col("left"))).select(SOURCE, "cell", "start")
    in_order = Window.partitionBy(SOURCE).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, -1)
    last = (
        inside.join(edge, [SOURCE, "cell"]).withColumn("sum", F.col("start") + F.coalesce(F.sum(TOKENS).over(in_order), F.lit(0)))
        .where(F.col("sum") < F.col("left")).select(SOURCE, "block", F.col(ORDER).alias("last"))
    )
    cut = cells.where(whole).select(SOURCE, "block", "last").unionByName(last).groupBy(SOURCE, "block").agg(F.max("last").alias("until"))
    rows = settled.join(cut, [SOURCE, "block"], "left").where((F.col("passes") > 0) | (F.col("left") > 0))
    return rows.select(SOURCE, "block", "blocks", "weight", "passes", "left", "place", "until"), totals.count() * MOST_BLOCKS


def mix(docs: DataFrame, budget_tokens: int | None = None, entropy_share: float = 0.97, most_repeats: float = 4.0) -> DataFrame:
    """``docs`` once for each time that the mixture takes them.

    Adds ``n_tokens``, ``weight`` of the source, ``epoch`` (pass, from 1), ``block`` and ``place`` of the block in its source's
    permutation, in place of columns of the same names. Sorting by (epoch, a hash of source and place) gives a training order of whole blocks.
    """
    with_place = placed(docs)
    planned, size = plan(with_place, budget_tokens, entropy_share, most_repeats)
    counts = planned.select(F.col(SOURCE), "blocks").distinct()
    renamed = planned.toDF(SOURCE, "__llm_block", "__llm_blocks", *(f"__llm_{c}" for c in ("weight", "passes", "left", "place", "until")))
    hint = F.broadcast if size <= BROADCAST_ROWS else (lambda df: df)
    spots = with_place.join(hint(counts.withColumnRenamed("blocks", "__llm_count")), SOURCE).withColumn(
        "__llm_at", (F.col(SPOT) % F.col("__llm_count")).cast("int")
    )
    chosen = spots.join(
        hint(renamed.withColumnRenamed(SOURCE, "__llm_same")),
        (F.col(SOURCE) == F.col("__llm_same")) & (F.col("__llm_at") == F.col("__llm_block")),
    )
    part = (F.col("__llm_left") > 0) & (F.col("__llm_until").isNull() | (F.col(ORDER) <= F.col("__llm_until")))
    times = F.col("__llm_passes") + part.cast("long")
    return chosen.where(times > 0).select(
        *(c for c in docs.columns if c not in ADDED), F.col(TOKENS).alias("n_tokens"), F.col("__llm_weight").alias("weight"),
        F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("epoch"),
        F.col("__llm_block").alias("block"), F.col("__llm_place").alias("place"),
    )
