"""Quality rules: text statistics and a decision list learned from labelled rows, all as column expressions.

The list is learned by sequential covering. A rule is a conjunction of thresholds that marks bad
documents. It grows on two thirds of the labelled rows, one condition at a time by information gain, and
is pruned on the other third; rows that a rule covers are taken out before the next rule is learned.
Each step is one aggregation: labelled rows are counted by (statistic, cut, label), and every threshold's
counts follow from running sums over these few rows. The result is one CASE expression.

Null and empty texts have no words and zero statistics. Labels other than 0 and 1 are ignored; without
labels of both kinds the list is empty and keeps everything. A document labelled twice counts twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casario.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
ROW = "__llm_row"
# Labelled rows learned from, at most: the rows with the least hashes. More rows hardly move cut points.
SAMPLE_ROWS = 20_000
CUTS = 24

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbol_share", "upper_share", "dup_line_share", "repeat_share", "word_length", "distinct_share", "words_per_line")


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice. Sorting (hash, place) brings equal windows together."""
    sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twins = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twins, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    # transform over a one-element array names a value once, so it is computed once
    found = F.transform(F.array(sorted_), places)
    return F.get(F.transform(found, covered), F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """(row, base statistics, ratios) of each document from one scan; ``__llm_row`` holds all its columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    split = docs.select(F.struct(*docs.columns).alias(ROW), text.alias("text")).select(
        ROW,
        F.when(trimmed != "", F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")).alias("words"),
        F.filter(F.split("text", r"\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    window = F.transform(
        F.slice("words", 1, n - WINDOW + 1),
        lambda word, i: F.xxhash64(word, *(F.get("words", i + k) for k in range(1, WINDOW))),
    )
    hashed = split.select(
        ROW, "words", "lines", n.cast("long").alias("n_words"),
        F.array_join("words", "").alias("body"),
        F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    counted = hashed.select(
        ROW, "n_words",
        F.length("body").cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long"))
        .otherwise(_repeated_words(F.col("windows"))).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("body", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    done = F.struct(
        ROW, *BASE,
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("word_length"), share("n_distinct", "n_words").alias("distinct_share"),
        share("n_words", "n_lines").alias("words_per_line"),
    )
    # filters over statistics stop at the generator; pushed below it, they would compute everything anew for each use
    return counted.select(F.inline(F.array(done)))


def base_failed() -> Column:
    """The fixed rules that hold before any learned one."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.name) > F.lit(self.cut) if self.above else F.col(self.name) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, null if none: an ordered CASE expression."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        out = F.when(_holds(rules[k]), F.lit(k)).otherwise(out)
    return out


def cut_points(rows: DataFrame, names: tuple[str, ...]) -> dict[str, list[float]]:
    """Candidate thresholds: midway between quantiles of either label, so that rare bad rows have cuts too."""
    shares = [k / CUTS for k in range(1, CUTS)] + [0.0, 0.01, 0.99, 1.0]
    per_label = rows.groupBy("bad").agg(*(F.percentile_approx(n, shares, 10_000).alias(n) for n in names)).collect()
    values = {n: sorted({float(v) for row in per_label for v in (row[n] or [])}) for n in names}
    return {n: [(low + high) / 2 for low, high in zip(points, points[1:])] for n, points in values.items()}


def _cell(value: Column, points: list[float]) -> Column:
    """Number of points below the value."""
    return F.size(F.filter(F.array(*map(F.lit, points)), lambda point: point < value))


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """For each statistic, counts of (good, bad) rows by the number of cuts below the value."""
    cells = F.array(*(
        F.struct(F.lit(n).alias("name"), _cell(F.col(n), points).alias("cell")) for n, points in cuts.items() if points
    ))
    table = {n: [[0, 0] for _ in range(len(points) + 1)] for n, points in cuts.items()}
    if not any(cuts.values()):
        return table
    for row in rows.select("bad", F.inline(cells)).groupBy("name", "cell", "bad").count().collect():
        table[row["name"]][row["cell"]][row["bad"]] = row["count"]
    return table


def _best(table: dict, cuts: dict[str, list[float]], least: int) -> tuple[float, Condition] | None:
    """The condition of the greatest information gain among those that leave ``least`` bad rows."""
    best = None
    for name, cells in table.items():
        good, bad = (sum(c[k] for c in cells) for k in (0, 1))
        if not good or not bad:
            continue
        start, g, b = math.log2(bad / (good + bad)), 0, 0
        for k, cut in enumerate(cuts[name]):
            g, b = g + cells[k][0], b + cells[k][1]
            for above, gk, bk in ((False, g, b), (True, good - g, bad - b)):
                if bk >= least:
                    gain = bk * (math.log2(bk / (gk + bk)) - start)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = gain, Condition(name, above, cut)
    return best


def _tested(rows: DataFrame, rule: Rule) -> list[tuple[int, int]]:
    """(good, bad) covered by each leading part of a rule."""
    sums = []
    for n in range(1, len(rule) + 1):
        held = _holds(rule[:n])
        sums += [F.count(F.when(held & (F.col("bad") == k), 1)).alias(f"c{n}_{k}") for k in (0, 1)]
    row = rows.agg(*sums).first()
    return [(row[f"c{n}_0"], row[f"c{n}_1"]) for n in range(1, len(rule) + 1)]


def learn(labelled: DataFrame, names: tuple[str, ...], precision: float = 0.95, longest: int = 4, most: int = 8, least: int = 5) -> list[Rule]:
    """Decision list for rows with the statistics ``names``, ``bad`` (0/1) and ``pruning`` (boolean).

    Growing ends when no good row is covered or at ``longest`` conditions. A rule is cut back to the leading part that
    is best on pruning rows, and the list ends at a rule whose precision there is below ``precision``.
    """
    rules: list[Rule] = []
    cuts = cut_points(labelled, names)
    rest = labelled
    while len(rules) < most:
        grown: Rule = ()
        active = rest.where(~F.col("pruning"))
        while len(grown) < longest:
            found = _best(_counts(active, cuts), cuts, least)
            if found is None:
                break
            grown, active = (*grown, found[1]), active.where(found[1].column())
        if not grown:
            break
        tested = _tested(rest.where("pruning"), grown)
        worth = [(b - g) / (b + g) if b + g else -1.0 for g, b in tested]
        n = max(range(len(grown)), key=lambda k: (worth[k], -k))
        good, bad = tested[n]
        if bad < 1 or bad / (good + bad) < precision:
            break
        rules.append(grown[: n + 1])
        rest = rest.where(~_holds(rules[-1]))
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from labelled documents that the base rules keep; label ``quality`` 0 is bad."""
    known = (
        labels.where(F.col("quality").isin(0, 1))
        .select("doc_id", (1 - F.col("quality")).alias("__llm_bad"), F.xxhash64("doc_id").alias("__llm_hash"))
        .orderBy("__llm_hash", "doc_id", "__llm_bad").limit(sample_rows)
    )
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")).where(~base_failed())
    held = cut_lineage(rows.select(
        *RATIOS, "n_words", F.col(f"{ROW}.__llm_bad").alias("bad"), (F.pmod(f"{ROW}.__llm_hash", F.lit(3)) == 0).alias("pruning")
    ))
    return learn(held, (*RATIOS, "n_words"))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``base_failed``, ``rule`` (the learned rule that rejects it, or null) and ``kept``."""
    return stats.withColumns({"base_failed": base_failed(), "rule": decision(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Row, statistics, rule and verdict of every document."""
    return judge(statistics(docs), learn_from(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither a base rule nor a learned one rejects."""
    return quality(docs, labels).where("kept").select(f"{ROW}.*")
