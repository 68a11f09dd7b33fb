"""Repeated substrings: bytes covered by strings of ``length`` bytes that start more than once in the corpus.

Suffix arrays need the texts that may match in one place, and pairs of document shards grow with the square of their number.
So shards are cut by content. Every window of ``length`` bytes names an anchor, the gram of least hash in it; windows next
to each other share theirs, so a text becomes runs of windows with one anchor. Equal windows have equal anchors: a run
whose anchor occurs once in the corpus repeats nothing, and that leaves out nearly all of a clean corpus before
any text moves.

1. Runs (anchor hash, content hash, place) are counted by anchor; anchors that occur once are dropped.
2. Runs of equal content repeat as a whole.
3. Of anchors with several contents, one text of each is fetched. A shard holds the texts of some anchors, a few MB at
   most: its suffixes are sorted by refinement (ranks of a quarter of the length, doubled twice), and Kasai's rule
   gives the common prefixes of neighbours: one byte decides where a neighbour's neighbour is known, all bytes elsewhere.
4. An anchor with more texts than a shard takes is split over several; their windows are merged by hash.
5. Marked windows go back to all runs of their content, then to documents.

The same steps, over words in place of bytes, count the starts of passages of ``passage_words`` words that also stand in
another document: passages of some fifty words are often shorter than ``length`` bytes, so removal leaves them alone. Words are
separated by white space, A-Z count as a-z; rows that repeat doc_id and text are one document for this count.

Neighbouring runs of equal content, as in a text of one repeated cell, are one row with their number.
Matches never cross documents; strings are judged on the input. Null texts are empty. Rows that repeat doc_id and text are
documents of their own for counting, so their texts repeat, and get equal results. Contents are compared by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casario.llm.arrays import chunks, mix, prefix_sums, slice_hashes, utf8, words
from casario.llm.frames import K2, with_key
from casario.llm.suffixes import symbol_sums
from casario.session import cut_lineage

LENGTH = 400
PASSAGE_WORDS = 51
SHARD_BYTES = 2 << 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, from running minima of blocks to either side."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(sums: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, repeats, anchor hash, content hash) of the runs of a chunk; places are within the chunk.

    ``sums`` are the running sums of its symbols. A run may be followed by ``repeats`` - 1 runs of the same content, end to end.
    """
    symbols = len(sums) - 1
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if symbols < length:
        return none
    gram = max(length * 5 // 16, 1)
    begins = np.arange(symbols - gram + 1)
    hashes = slice_hashes(sums, begins, begins + gram)
    # the place breaks ties of the hash's upper bits to the left, in all copies alike
    bits = np.uint64(symbols.bit_length())
    least = sliding_least((hashes >> bits << bits) | begins.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    size = np.diff(offsets)
    full = np.flatnonzero(size >= length)
    if not len(full):
        return none
    count = size[full] - length + 1
    first = np.repeat(offsets[full] - (np.cumsum(count) - count), count)
    window = np.arange(count.sum()) + first
    named = anchor[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (named[1:] != named[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(window)))
    start, at = window[begin], named[begin]
    content = mix(slice_hashes(sums, start, start + windows - 1 + length) ^ (at - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (content[1:] != content[:-1]) | (windows[1:] != windows[:-1]) | (start[1:] != start[:-1] + windows[:-1])
    kept = np.flatnonzero(fresh)
    repeats = np.diff(np.append(kept, len(start)))
    start, at = start[kept], at[kept]
    return np.searchsorted(offsets, start, side="right") - 1, start, windows[kept], repeats, hashes[at], content[kept]


def _word_sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over the words of a chunk, and the offsets of its documents among them."""
    hashes, owner, _, _ = words(data, offsets, "space")
    return symbol_sums(hashes), np.searchsorted(owner, np.arange(len(offsets)))


RUNS = "anchor long, content long, by_word boolean, windows int"


def _anchors(length: int, passage_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for start, stop in chunks(offsets):
                piece, part = data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
                for by_word in (False, True):
                    sums, edges = _word_sums(piece, part) if by_word else (prefix_sums(piece), part)
                    doc, place, windows, repeats, anchor, content = runs_of(sums, edges, passage_words if by_word else length)
                    rows = pa.array(doc + start)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(rows), batch.column(K2).take(rows), pa.array(anchor.view(np.int64)),
                            pa.array(content.view(np.int64)), pa.array(np.full(len(doc), by_word)), pa.array(windows.astype(np.int32)),
                            pa.array(place - edges[doc]), pa.array(repeats),
                        ],
                        ["doc_id", K2, "anchor", "content", "by_word", "windows", "start", "repeats"],
                    )

    return run


def _cut_out(length: int, passage_words: int):
    """Bytes of the wanted runs of each document; of runs of words, the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = (batch.column("text")[r].as_py() or "").encode()
                wanted = batch.column("wanted")[r].as_py()
                if any(w["by_word"] for w in wanted):
                    data = np.frombuffer(text, dtype=np.uint8)
                    sums, _ = _word_sums(data, np.array([0, len(data)]))

                def cut(w: dict) -> bytes:
                    if not w["by_word"]:
                        return text[w["start"] : w["start"] + w["windows"] - 1 + length]
                    at = np.arange(w["start"], w["start"] + w["windows"])
                    return slice_hashes(sums, at, at + passage_words).tobytes()

                for k in range(0, len(wanted), 2000):
                    rows = wanted[k : k + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array([w[c] for w in rows], pa.int64()) for c in ("anchor", "contents", "content")),
                            pa.array([w["by_word"] for w in rows], pa.bool_()), pa.array([w["windows"] for w in rows], pa.int32()),
                            *(pa.array([w[c] for w in rows], pa.int64()) for c in ("low", "high")),
                            pa.array([cut(w) for w in rows], pa.binary()),
                        ],
                        ["anchor", "contents", "content", "by_word", "windows", "low", "high", "raw"],
                    )

    return run


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the runs of words that ``_cut_out`` returns."""
    names = ["anchor", "content", "low", "high"]
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            hashes = np.frombuffer(b"".join(part.column("raw").to_pylist()), dtype=np.int64)
            rows = pa.array(np.repeat(np.arange(part.num_rows), part.column("windows").to_numpy()))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in names), pa.array(hashes)], [*names, "hash"])


def repeated_windows(texts: list[bytes], length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each text of a shard, which of its windows also start elsewhere in the shard; all windows' places and hashes.

    A suffix array of the windows by Larsson and Sadakane's refinement. The first ranks are those of hashes of
    a quarter of the length, which sort equal prefixes together in some order; each doubling ranks pairs.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - length + 1, 0)
    window = np.arange(count.sum()) + np.repeat(base - (np.cumsum(count) - count), count)
    sums = prefix_sums(data)
    h = max(length // 4, 1)
    ends = np.minimum(np.arange(len(data)) + h, len(data))
    _, rank = np.unique(slice_hashes(sums, np.arange(len(data)), ends), return_inverse=True)
    rank = rank.astype(np.int64)
    while h < length:
        step = min(h, length - h)
        further = np.zeros(len(data), dtype=np.int64)
        further[: len(data) - step] = rank[step:]
        # places too near the end of their text sort somewhere; no window is among them
        _, rank = np.unique(rank * (len(data) + 1) + further, return_inverse=True)
        h += step
    order = np.argsort(rank[window], kind="stable")
    sa = window[order]
    tied = np.zeros(len(sa), dtype=bool)
    tied[1:] = rank[sa[1:]] == rank[sa[:-1]]
    before = np.full(len(data) + 1, -1, dtype=np.int64)
    before[sa[1:][tied[1:]]] = sa[:-1][tied[1:]]
    # Kasai: if the place before has the place before the neighbour as its neighbour, only the last byte is new
    sorted_before = before[window]
    previous = np.where(window > 0, before[window - 1], -1)
    known = (sorted_before >= 0) & (previous >= 0) & (previous + 1 == sorted_before)
    equal = np.zeros(len(window), dtype=bool)
    equal[known] = data[window[known] + length - 1] == data[sorted_before[known] + length - 1]
    rest = np.flatnonzero((sorted_before >= 0) & ~known)
    for part in np.array_split(rest, max(1, len(rest) * length // (8 << 20))):
        span = np.arange(length)
        equal[part] = (data[window[part][:, None] + span] == data[sorted_before[part][:, None] + span]).all(axis=1)
    twice = np.zeros(len(data) + 1, dtype=bool)
    twice[window[equal]] = True
    twice[sorted_before[equal]] = True
    hashes = slice_hashes(sums, window, window + length)
    return np.split(twice[window], np.cumsum(count)[:-1]), window, hashes


def _spans(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


def _shards(length: int, shard_bytes: int):
    def solve(rows: list[dict]) -> pa.RecordBatch:
        flags, _, hashes = repeated_windows([r["raw"] for r in rows], length)
        ends = np.cumsum([len(f) for f in flags])
        windows = [hashes[e - len(f) : e].view(np.int64) if r["parts"] > 1 else np.zeros(0, np.int64) for r, f, e in zip(rows, flags, ends)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["anchor"] for r in rows], pa.int64()), pa.array([r["content"] for r in rows], pa.int64()),
                pa.array([_spans(f) for f in flags], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                pa.array(windows, pa.list_(pa.int64())),
            ],
            ["anchor", "content", "spans", "hashes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["anchor"], row["part"])
                if at != key and size >= shard_bytes:
                    yield solve(held)
                    held, size = [], 0
                key = at
                held.append(row)
                size += len(row["raw"])
        if held:
            yield solve(held)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, k2, spans, shared) of documents with repeated strings or passages.

    ``spans`` are byte ranges that cover the strings, overlapping as found. ``shared`` counts the words at which a passage starts
    that also stands in another document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = with_key(docs.select("doc_id", "text")).select("doc_id", K2, "text")
    runs = cut_lineage(keyed.mapInArrow(_anchors(length, passage_words), f"doc_id {kind}, {K2} long, {RUNS}, start long, repeats long"))
    repeated = runs.groupBy("anchor").agg(F.sum("repeats").alias("n")).where("n > 1").select("anchor")
    again = cut_lineage(runs.join(repeated, "anchor"))
    contents = again.groupBy("anchor", "content", "by_word").agg(
        F.sum("repeats").alias("n"), F.min(K2).alias("low"), F.max(K2).alias("high"), F.min(F.struct("doc_id", K2, "start", "windows")).alias("one")
    )
    several = contents.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("one.windows") - 1).alias("b")))
    nowhere, unshared = F.expr("array()").cast("array<struct<a:int,b:int>>"), F.lit(0).cast("long")
    copied = contents.where("n > 1 and not by_word").select("anchor", "content", whole.alias("spans"), unshared.alias("shared"))
    common = contents.where("by_word and low < high").select("anchor", "content", nowhere.alias("spans"), F.col("one.windows").cast("long").alias("shared"))

    wanted = contents.join(several, "anchor").groupBy(
        F.col("one.doc_id").alias("__llm_id"), F.col(f"one.{K2}").alias("__llm_same")
    ).agg(F.collect_list(F.struct("anchor", "contents", "content", "by_word", "low", "high", "one.start", "one.windows")).alias("wanted"))
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col(K2) == F.col("__llm_same"))).select("wanted", "text")
    cut = cut_lineage(texts.mapInArrow(
        _cut_out(length, passage_words), "anchor long, contents long, content long, by_word boolean, windows int, low long, high long, raw binary"
    )).dropDuplicates(["anchor", "content"])
    parts = F.ceil(F.col("contents") * (2 * length) / shard_bytes).cast("int")
    spread = cut.where("not by_word").withColumn("parts", parts).withColumn("part", F.pmod("content", F.col("parts")).cast("int"))
    solved = cut_lineage(
        spread.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
        .mapInArrow(_shards(length, shard_bytes), "anchor long, content long, spans array<struct<a:int,b:int>>, hashes array<long>")
    )
    within = solved.where(F.size("spans") > 0).select("anchor", "content", "spans", unshared.alias("shared"))
    open_ = solved.where(F.size("hashes") > 0).select("anchor", "content", F.posexplode("hashes").alias("a", "hash"))
    shared = open_.groupBy("hash").count().where("count > 1").select("hash")
    across = open_.join(shared, "hash").groupBy("anchor", "content").agg(
        F.collect_list(F.struct("a", F.col("a").alias("b"))).alias("spans")
    ).withColumn("shared", unshared)
    passages = cut.where("by_word").mapInArrow(_window_hashes, "anchor long, content long, low long, high long, hash long")
    met = passages.groupBy("anchor", "hash").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("anchor", "hash")
    # a content that is common as a whole is marked already
    partly = passages.where("low = high").join(met, ["anchor", "hash"]).groupBy("anchor", "content").agg(F.count("*").alias("shared"))
    marked = copied.unionByName(within).unionByName(across).unionByName(common).unionByName(
        partly.select("anchor", "content", nowhere.alias("spans"), "shared")
    )
    # runs that follow each other overlap, so their spans join
    found = again.join(marked, ["anchor", "content"]).select(
        "doc_id", K2, F.col("start").alias("s"), ((F.col("repeats") - 1) * F.col("windows")).alias("more"),
        (F.col("shared") * F.col("repeats")).alias("shared"), F.inline_outer("spans"),
    )
    span = F.struct((F.col("s") + F.col("a")).alias("start"), (F.col("s") + F.col("more") + F.col("b") + length).alias("end"))
    # sets, so that rows that repeat count once
    starts = F.collect_set(F.when(F.col("shared") > 0, F.struct("s", "shared")))
    return found.groupBy("doc_id", K2).agg(
        F.collect_set(F.when(F.col("a").isNotNull(), span)).alias("spans"),
        F.aggregate(starts, F.lit(0).cast("long"), lambda total, x: total + x["shared"]).alias("shared"),
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of byte ranges; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with ``__llm_kept`` (bytes left, as binary: a cut may fall inside a character), ``__llm_spans`` (removed ranges)
    and ``__llm_shared`` (starts of passages that also stand in another document)."""
    spans = repeated_spans(docs, length, shard_bytes, passage_words).select(
        F.col("doc_id").alias("__llm_id"), F.col(K2).alias("__llm_same"), F.col("spans").alias("__llm_found"), F.col("shared").alias("__llm_shared")
    )
    joined = with_key(docs).join(
        spans, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col(K2) == F.col("__llm_same")), "left"
    ).select(*docs.columns, "__llm_found", F.coalesce("__llm_shared", F.lit(0)).alias("__llm_shared"))
    range_type = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([
        *docs.schema.fields, T.StructField("__llm_kept", T.BinaryType()), T.StructField("__llm_spans", T.ArrayType(range_type)),
        T.StructField("__llm_shared", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ranges = [], []
            for cell, found in zip(batch.column("text"), batch.column("__llm_found").to_pylist()):
                text, done, parts = (cell.as_py() or "").encode(), 0, []
                union = merged([(f["start"], f["end"]) for f in found or []])
                for start, end in union:
                    parts.append(text[done:start])
                    done = end
                kept.append(b"".join([*parts, text[done:]]))
                ranges.append([{"start": s, "end": e} for s, e in union])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in docs_fields), pa.array(kept, pa.binary()),
                    pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    batch.column("__llm_shared"),
                ],
                schema.names,
            )

    docs_fields = list(docs.schema.fields)
    return joined.mapInArrow(run, schema)
