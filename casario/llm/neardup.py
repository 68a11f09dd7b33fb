"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Each text becomes the set of its word 5-grams (fewer words, but not none: one gram of all). Texts of equal sets are one
   class; from here on there is one row per class, so copies cost nothing more.
2. Band and row counts follow from the threshold and the target recall. Classes that share a band hash are a
   group. Groups with the same members are found by sums over members and kept once.
3. Members of groups fetch their sets, one row per (group, member). A group of more than ``block`` classes is
   cut into blocks, and each pair of blocks is one unit of work. Within a unit, intersections come from products of
   0/1 matrices over chunks of shared grams; a pair is counted in the first group that it shares.
4. Units return per class the number of linked documents and one edge of a spanning forest, never pairs. Components
   of these edges are the near-duplicate classes.

A link is a pair of documents with Jaccard similarity of ``threshold`` or more. Null and empty texts have no grams and no links.
Rows that repeat doc_id and text are copies. Sets are compared by 64-bit gram hashes, classes by 64-bit set hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casario.llm.arrays import chunks, mix, utf8, word_ngrams, words
from casario.llm.components import components
from casario.llm.frames import K2, with_key
from casario.session import cut_lineage

N, THRESHOLD, RECALL = 5, 0.8, 0.9998
BLOCK = 1024
COLUMNS = 2048  # grams per matrix product


def banding(threshold: float, recall: float, most_hashes: int = 200) -> tuple[int, int]:
    """(bands, rows) that find a pair at the threshold with the target recall, rows as many as ``most_hashes`` allows."""
    best = None
    for rows in range(1, 16):
        miss = 1 - threshold**rows
        bands = 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within most_hashes")
    return best


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each document of a chunk."""
    hashes, owner, _, _ = words(data, offsets)
    grams, owner = word_ngrams(hashes, owner, n)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    return [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (documents x bands) of non-empty sets."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets)])[:-1]
    low = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(sets), bands), dtype=np.uint64)
    for band in range(bands):
        value = np.full(len(sets), np.uint64(band + 1))
        for k in range(band * rows, (band + 1) * rows):
            flip, factor = np.uint32(seeds[2 * k] & np.uint64(0xFFFFFFFF)), np.uint32(seeds[2 * k + 1] & np.uint64(0xFFFFFFFF)) | np.uint32(1)
            scrambled = (low ^ flip) * factor
            scrambled ^= scrambled >> np.uint32(15)
            least = np.minimum.reduceat(scrambled * np.uint32(0x2C1B3C6D), begin)
            value = mix(value * np.uint64(0xD6E8FEB86659FD93) + least.astype(np.uint64))
        out[:, band] = value
    return out


def _narrow(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for start, stop in chunks(offsets):
                part = offsets[start : stop + 1]
                sets = gram_sets(data[part[0] : part[-1]], part - part[0], n)
                some = np.array([k for k, s in enumerate(sets) if len(s)], dtype=np.int64)
                full = [sets[k] for k in some]
                key = np.array([int(mix(s).sum() ^ np.uint64(len(s))) if len(s) else 0 for s in full], dtype=np.uint64)
                table = signatures(full, bands, rows) if full else np.zeros((0, bands), np.uint64)
                s, lists = np.zeros(stop - start, dtype=np.int64), np.zeros(stop - start + 1, dtype=np.int32)
                s[some] = key.view(np.int64)
                lists[1:][some] = bands
                valid = np.zeros(stop - start, dtype=bool)
                valid[some] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start), batch.column(K2).slice(start, stop - start),
                        pa.array(s, mask=~valid),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(lists, dtype=np.int32)), pa.array(table.ravel().view(np.int64))),
                    ],
                    ["doc_id", K2, "s", "bands"],
                )

    return run


def _fetch(n: int):
    """Sets of candidate texts as bytes, with the groups of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for start, stop in chunks(offsets):
                part = offsets[start : stop + 1]
                sets = gram_sets(data[part[0] : part[-1]], part - part[0], n)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, stop - start) for c in ("s", "copies", "groups")), pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["s", "copies", "groups", "grams"],
                )

    return run


def _members(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column, columns) of the values that occur in two lists or more."""
    flat = np.concatenate(lists)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    twice = count[column] > 1
    return row[twice], number[column[twice]], int(number[-1]) + 1 if len(number) else 0


def _common(lists: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` lists with all lists."""
    row, column, width = _members(lists)
    out = np.zeros((left, len(lists)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        matrix = np.zeros((len(lists), min(COLUMNS, width - start)), dtype=np.float32)
        matrix[row[a:b], column[a:b] - start] = 1
        out += matrix[:left] @ matrix.T
    return out


def links_of_unit(group: int, sets: list[np.ndarray], groups: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Linked pairs (first, second) among the members of a unit that no earlier group of theirs holds.

    ``left`` members are the first block; with all members in one block, pairs are taken once.
    """
    n = len(sets)
    if n == 2:  # most units
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        union = len(sets[0]) + len(sets[1]) - common
        shared = np.intersect1d(groups[0], groups[1], assume_unique=True)
        good = common >= threshold * union - 1e-9 and shared[0] == group
        return np.array([(0, 1)] if good else [], dtype=np.int64).reshape(-1, 2)
    common = _common(sets, left)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    linked = common >= threshold * (sizes[:left, None] + sizes[None, :] - common) - 1e-6
    if left == n:
        linked &= np.triu(np.ones((n, n), dtype=bool), 1)
    else:
        linked[:, :left] = False
    before = [g[g < group] for g in groups]
    if linked.any() and sum(map(len, before)):
        linked &= _common(before, left) == 0
    return np.argwhere(linked)


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Least member reachable from each of ``n`` members over ``pairs``."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _verify(threshold: float):
    def unit(rows: list[tuple]) -> list[tuple[int, int, int]]:
        if len(rows) < 2:
            return []
        rows.sort(key=lambda r: (r["side"], r["s"]))
        left = sum(r["side"] == 0 for r in rows)
        if left == 0 or (rows[0]["cross"] and left == len(rows)):
            return []
        sets = [np.frombuffer(r["grams"], dtype=np.uint64) for r in rows]
        groups = [np.array(r["groups"], dtype=np.int64) for r in rows]
        pairs = links_of_unit(rows[0]["g"], sets, groups, left, threshold)
        if not len(pairs):
            return []
        copies = np.array([r["copies"] for r in rows])
        total = np.zeros(len(rows), dtype=np.int64)
        np.add.at(total, pairs[:, 0], copies[pairs[:, 1]])
        np.add.at(total, pairs[:, 1], copies[pairs[:, 0]])
        label = forest(len(rows), pairs)
        return [(rows[k]["s"], int(total[k]), rows[label[k]]["s"]) for k in np.flatnonzero(total)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["s", "links", "root"])

        held, key = [], None
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["g"], row["i"], row["j"])
                if at != key:
                    out += unit(held)
                    held, key = [], at
                held.append(row)
            if len(out) > 10_000:
                yield flush()
        out += unit(held)
        yield flush()

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N, block: int = BLOCK) -> DataFrame:
    """(doc_id, k2, copy_class, component, copies, links) of every document.

    ``copy_class`` is null for texts without words. ``links`` counts the other documents that a document is linked with,
    copies included. ``component`` numbers the connected groups of linked documents.
    """
    bands, rows = banding(threshold, recall)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = with_key(docs.select("doc_id", "text"))
    narrow = cut_lineage(keyed.select("doc_id", "text", K2).mapInArrow(
        _narrow(bands, rows, n), f"doc_id {doc_type}, {K2} long, s long, bands array<long>"
    ))
    classes = cut_lineage(narrow.where(F.col("s").isNotNull()).groupBy("s").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", K2)).alias("first"), F.any_value("bands").alias("bands")
    ))
    banded = classes.select("s", F.explode("bands").alias("g"))
    groups = banded.groupBy("g").agg(
        F.count("*").alias("c"), F.sum(F.xxhash64("s") % (1 << 40)).alias("sum"), F.min("s").alias("least"), F.max("s").alias("most")
    ).where("c > 1")
    kept = cut_lineage(groups.groupBy("c", "sum", "least", "most").agg(F.min("g").alias("g")).select("g", "c"))
    belongs = banded.join(kept, "g").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("g", "c"))).alias("groups"))
    wanted = belongs.join(classes.select("s", "copies", "first"), "s").select(
        "s", "copies", "groups", F.col("first.doc_id").alias("__llm_id"), F.col(f"first.{K2}").alias("__llm_same")
    )
    # one text for each candidate class: of rows that repeat (doc_id, text), any
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col(K2) == F.col("__llm_same"))).select(
        "s", "copies", F.col("groups"), "text"
    ).dropDuplicates(["s"])
    sets = texts.select("s", "copies", "groups", "text").mapInArrow(
        _fetch(n), "s long, copies long, groups array<struct<g:long,c:long>>, grams binary"
    )
    each = sets.select("s", "copies", "grams", F.col("groups.g").alias("groups"), F.explode("groups").alias("e"))
    blocks = F.ceil(F.col("e.c") / block).cast("int")
    mine = F.pmod(F.xxhash64("s"), blocks).cast("int")
    units = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(
        F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"), (mine > other).cast("int").alias("side"), (mine != other).alias("cross")
    ))
    work = each.select("s", "copies", "grams", "groups", F.col("e.g").alias("g"), F.explode(units).alias("u")).select(
        "g", "u.i", "u.j", "u.side", "u.cross", "s", "copies", "groups", "grams"
    )
    found = cut_lineage(
        work.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_verify(threshold), "s long, links long, root long")
    )
    links = found.groupBy("s").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("s").alias("u"), F.col("root").alias("v")))
    settled = classes.select("s", "copies").join(links, "s", "left").join(
        roots.select(F.col("node").alias("s"), "root"), "s", "left"
    ).select("s", "copies", F.coalesce("root", "s").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return narrow.drop("bands").join(settled, "s", "left").select(
        "doc_id", K2, F.col("s").alias("copy_class"), F.col("root").alias("component"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def named_classes(found: DataFrame) -> DataFrame:
    """Adds ``class_first``: the least (doc_id, k2) of each component, by which it is named; texts without words stand alone."""
    own = F.struct("doc_id", K2)
    first = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(own).alias("__llm_first"))
    joined = found.join(first, "component", "left")
    return joined.withColumn("class_first", F.coalesce("__llm_first", own)).drop("__llm_first")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """The documents with one of each near-duplicate class: the least by doc_id. All without words stay.

    Of rows that repeat doc_id and text one stays, unless the text has no words.
    """
    found = cut_lineage(named_classes(near_duplicates(docs, threshold, recall, n)))
    alone = F.col("component").isNull()
    stay = found.where(alone | F.struct("doc_id", K2).eqNullSafe(F.col("class_first"))).select(
        F.col("doc_id").alias("__llm_id"), F.col(K2).alias("__llm_same"), alone.alias("__llm_alone")
    ).distinct()
    kept = with_key(docs).join(stay, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col(K2) == F.col("__llm_same")))
    once = kept.where("NOT __llm_alone").dropDuplicates(["__llm_id", K2])
    return once.unionByName(kept.where("__llm_alone")).select(*docs.columns)
