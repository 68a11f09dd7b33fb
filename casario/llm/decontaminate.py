"""Benchmark decontamination by suffix arrays of the training texts.

Every task builds suffix arrays over the words of a few documents at a time (a shard) and looks up every
test window by binary search. That gives all occurrences of test windows, so the words they cover; each is followed
to its true end in the item, which gives the longest verbatim match of each document with its place (first word,
item). Matches shorter than a window are not reported. Texts are not shuffled.

Test items reach the tasks in blocks of a stated size: a benchmark larger than one block makes one pass for
each block, and each pass adds to what the passes before it found.

A word is a run of digits, letters and non-ASCII characters, A-Z lower-cased. A window is ``window`` consecutive
words of an item; an item of fewer words, but not none, is one window. Null texts have no words; items with a
null id count under the empty id; rows that repeat an item are one item. Each input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casario.llm.arrays import chunks, utf8, words
from casario.llm.suffixes import find, run_lengths, shared_length, suffix_array, symbol_sums

WINDOW = 10
BLOCK_BYTES = 16 << 20
# Windows searched at once.
QUERIES = 1 << 18

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_item", T.StringType()),
    T.StructField("longest_at", T.LongType()),
])


@dataclass
class Tests:
    """One block of test items as arrays, at most some 30 bytes a word, small enough to broadcast."""

    vocabulary: np.ndarray  # sorted word hashes; the symbol of a word is one more than its place
    symbols: np.ndarray  # of all items, a 0 after each
    sums: np.ndarray  # running sums for hashes of runs of symbols
    ends: np.ndarray  # place of the 0 of each item
    order: np.ndarray  # places where windows start, sorted by what follows up to the item's end
    group: np.ndarray  # first slot of ``order`` of each distinct window, and the end
    need: np.ndarray  # words of each distinct window
    ids: list[str]


def prepare(rows: list[tuple[object, str | None]], window: int) -> Tests:
    """Arrays of one block of (item id, text)."""
    ids = ["" if i is None else str(i) for i, _ in rows]
    data, offsets = utf8(pa.array([t for _, t in rows], pa.string()))
    hashes, owner, _, _ = words(data, offsets) if len(rows) else (np.zeros(0, np.uint64), np.zeros(0, int), None, None)
    vocabulary = np.unique(hashes)
    counts = np.bincount(owner, minlength=len(rows))
    ends = np.cumsum(counts) + np.arange(len(rows))
    symbols = np.zeros(len(hashes) + len(rows), dtype=np.int32)
    symbols[np.arange(len(hashes)) + owner] = np.searchsorted(vocabulary, hashes) + 1
    left = run_lengths(symbols)
    first = np.zeros(len(symbols), dtype=bool)
    first[(ends - counts)[counts > 0]] = True
    need = np.where(left >= window, window, np.where(first, left, 0))
    order = suffix_array(symbols, int(counts.max(initial=1)))
    order = order[need[order] > 0]
    need = need[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = need[1:] != need[:-1]
    for k in range(int(need.max(initial=0))):
        at = symbols[np.minimum(order + k, len(symbols) - 1)]
        new[1:] |= (at[1:] != at[:-1]) & (k < need[1:])
    group = np.flatnonzero(new)
    return Tests(
        vocabulary, symbols, symbol_sums(symbols), ends, order.astype(np.int32), np.append(group, len(order)).astype(np.int32),
        need[group].astype(np.int32), ids,
    )


def _symbols(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Union of (start, end) rows as disjoint spans."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    begin = np.flatnonzero(new)
    return list(zip(spans[begin, 0].tolist(), reach[np.append(begin[1:], len(spans)) - 1].tolist()))


def _longest(codes: np.ndarray, at: np.ndarray, query: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(words, place in the items) of the longest match that starts ``at`` each place, where a window occurs.

    Of the sorted suffixes that start with the window, a neighbour of the place's own suffix has most in common with it.
    """
    sums, runs = symbol_sums(codes), run_lengths(codes)
    first, last = tests.group[query].astype(np.int64), tests.group[query + 1].astype(np.int64) - 1

    def shared(which: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        item = tests.order[slots].astype(np.int64)
        most = np.minimum(runs[at[which]], tests.ends[np.searchsorted(tests.ends, item)] - item)
        return shared_length(sums, at[which], tests.sums, item, most), item

    low, high = first.copy(), last + 1
    while (going := np.flatnonzero(low < high)).size:
        middle = (low[going] + high[going]) // 2
        length, item = shared(going, middle)
        below = tests.symbols[item + length] < codes[at[going] + length]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
    every = np.arange(len(at))
    (before, one), (after, two) = shared(every, np.maximum(low - 1, first)), shared(every, np.minimum(low, last))
    return np.maximum(before, after), np.where(before >= after, one, two)


def match_shard(data: np.ndarray, offsets: np.ndarray, tests: Tests) -> tuple[np.ndarray, dict[int, dict]]:
    """Word counts of a shard's documents, and what was found in those that share words with tests."""
    n_docs = len(offsets) - 1
    hashes, owner, _, _ = words(data, offsets)
    counts = np.bincount(owner, minlength=n_docs)
    found: dict[int, dict] = {}
    if not len(tests.need) or not len(hashes):
        return counts, found
    # a 0 after each document keeps matches inside it
    place = np.arange(len(hashes)) + owner
    codes = np.zeros(len(hashes) + n_docs + 1, dtype=np.int64)
    codes[place] = _symbols(hashes, tests.vocabulary)
    first = np.cumsum(counts) - counts + np.arange(n_docs)
    sa = suffix_array(codes, int(tests.need.max()))

    at, query = [], []
    for k in range(0, len(tests.need), QUERIES):
        some = slice(k, k + QUERIES)
        low, high = find(codes, sa, tests.symbols, tests.need[some], tests.order[tests.group[:-1][some]].astype(np.int64))
        sizes = high - low
        at.append(sa[np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)])
        query.append(np.repeat(np.arange(k, k + len(sizes)), sizes))
    at, query = np.concatenate(at), np.concatenate(query)
    if not len(at):
        return counts, found
    need = tests.need[query].astype(np.int64)
    verbatim, item = _longest(codes, at, query, tests)
    docs = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((at, docs))
    for mine in np.split(order, np.flatnonzero(np.diff(docs[order])) + 1):
        d = int(docs[mine[0]])
        starts = at[mine] - first[d]
        top = mine[np.argmax(verbatim[mine])]
        owners = np.unique(np.concatenate([np.searchsorted(tests.ends, tests.order[tests.group[q] : tests.group[q + 1]]) for q in np.unique(query[mine])]))
        found[d] = {
            "items": {tests.ids[i] for i in owners},
            "spans": np.stack([starts, starts + need[mine]], axis=1),
            "longest": (int(verbatim[top]), tests.ids[np.searchsorted(tests.ends, item[top])], int(at[top] - first[d])),
        }
    return counts, found


def _pass(broadcast, name: str, again: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = broadcast.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out: list[dict] = batch.column(name).to_pylist() if again else []
            for start, stop in chunks(offsets):
                part = offsets[start : stop + 1]
                counts, found = match_shard(data[part[0] : part[-1]], part - part[0], tests)
                for k in range(stop - start):
                    if not again:
                        out.append({"n_words": int(counts[k]), "items": [], "spans": [], "longest": 0, "longest_item": None, "longest_at": None})
                    if k in found:
                        row, new = out[start + k], found[k]
                        old = np.array([(s["start"], s["end"]) for s in row["spans"]], dtype=np.int64).reshape(-1, 2)
                        row["spans"] = [{"start": s, "end": e} for s, e in _merged(np.concatenate((old, new["spans"])))]
                        row["items"] = sorted({*row["items"], *new["items"]})
                        if new["longest"][0] > row["longest"]:
                            row["longest"], row["longest_item"], row["longest_at"] = new["longest"]
            column = pa.array(out, pa.struct([
                ("n_words", pa.int64()), ("items", pa.list_(pa.string())),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ("longest", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64()),
            ]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], [*names, name])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "__llm_found") -> DataFrame:
    """``docs`` with a struct of what was found: words, items, disjoint spans of hit words, the longest match."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs
    schema = T.StructType([*docs.schema.fields, T.StructField(into, FOUND)])
    for block in range(blocks):
        share = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        tests = spark.sparkContext.broadcast(prepare([tuple(r) for r in share.distinct().collect()], window))
        out = out.mapInArrow(_pass(tests, into, block > 0, docs.columns), schema)
    return out


def hit_words(spans: Column) -> Column:
    """Words inside disjoint spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, unchanged, in which no test window occurs."""
    return matches(docs, benchmark, window).where(F.size("__llm_found.spans") == 0).select(*docs.columns)
