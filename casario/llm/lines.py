"""Line dedup: lines that many documents share, found without moving texts.

Tasks hash the lines of their documents. The hashes are range-partitioned and sorted by (hash, document, position), so one
stream per partition sees all lines of a key together, first occurrence first, and needs only the rows of a
few documents at a time. A key with a third of all lines is split over many partitions: what touches the
edge of a partition is settled by counts of edge keys, of which there are two per partition. The answer is a
compressed bitmap of lines to keep per document; texts meet it once, at the end.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Null and empty texts are one
empty line. Keys are compared by 64-bit hashes. Rows that repeat both doc_id and text are one document and are all returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casario.llm.arrays import INSIDE, LOWER, chunks, prefix_sums, slice_hashes, utf8
from casario.llm.frames import K2, with_key
from casario.session import cut_lineage

DROP, FIRST, EDGE = 0, 1, 2
NEWLINE = 0x0A


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, start, end) of all lines of a chunk of documents."""
    breaks = np.flatnonzero(data == NEWLINE)
    n_docs = len(offsets) - 1
    # each document ends a line, also an empty one
    owner = np.concatenate((np.searchsorted(offsets, breaks, side="right") - 1, np.arange(n_docs)))
    ends = np.concatenate((breaks, offsets[1:]))
    order = np.lexsort((np.concatenate((np.zeros(len(breaks), np.int8), np.ones(n_docs, np.int8))), ends, owner))
    owner, ends = owner[order], ends[order]
    first = np.ones(len(ends), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    starts = np.empty(len(ends), dtype=np.int64)
    starts[1:] = ends[:-1] + 1
    starts[first] = offsets[:-1]
    begin = np.flatnonzero(first)
    position = np.arange(len(ends)) - np.repeat(begin, np.diff(np.append(begin, len(ends))))
    return owner, position, starts, ends


def line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, key hash) of the lines whose key has ``min_chars`` code points or more."""
    owner, position, starts, ends = line_bounds(data, offsets)
    solid = INSIDE["space"][data]
    places = np.flatnonzero(solid)
    before = np.concatenate(([0], np.cumsum(solid)))
    some = before[ends] > before[starts]
    low, high = starts.copy(), starts.copy()
    low[some] = places[before[starts[some]]]
    high[some] = places[before[ends[some]] - 1] + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = points[high] - points[low] >= min_chars
    hashes = slice_hashes(prefix_sums(LOWER[data]), low[long], high[long])
    return owner[long], position[long], hashes


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h, doc_id, k2, pos) of every line that has a key."""
    id_field = docs.schema["doc_id"]
    schema = T.StructType([
        T.StructField("h", T.LongType()), T.StructField("doc_id", id_field.dataType),
        T.StructField(K2, T.LongType()), T.StructField("pos", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for start, stop in chunks(offsets):
                part = offsets[start : stop + 1]
                owner, position, hashes = line_keys(data[part[0] : part[-1]], part - part[0], min_chars)
                rows = pa.array(owner + start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), batch.column("doc_id").take(rows), batch.column(K2).take(rows), pa.array(position.astype(np.int32))],
                    ["h", "doc_id", K2, "pos"],
                )

    return with_key(docs.select("doc_id", "text")).select("doc_id", "text", K2).mapInArrow(run, schema)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each row differs from the row before it; nulls are equal."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        differ = pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b)))
        out[1:] = differ.to_numpy(zero_copy_only=False)
    return out


def _stream(min_docs: int):
    """Streams one sorted partition: rows of keys that reach ``min_docs`` documents, and rows at its edges.

    Between batches it carries the rows of the last key while that key is undecided, which are those of fewer
    than ``min_docs`` documents, or one row of it once it is decided.
    """

    def emit(rows: pa.RecordBatch, status: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
        full = pa.RecordBatch.from_arrays([*rows.columns, pa.array(status.astype(np.int32))], [*rows.schema.names, "status"])
        return full.filter(pa.array(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.RecordBatch | None = None
        sent, opening = 0, None  # rows of ``carried`` that were sent; the first key of the partition
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = batch
            if carried is not None:
                rows = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            key = rows.column("h").to_numpy()
            if opening is None:
                opening = key[0]
            runs = _changes(rows.column("h"))
            fresh = runs | _changes(rows.column("doc_id")) | _changes(rows.column(K2))
            begin = np.flatnonzero(runs)
            size = np.diff(np.append(begin, len(key)))
            docs = np.add.reduceat(fresh.astype(np.int64), begin)
            if sent:
                docs[0] = min_docs
            frequent = np.repeat(docs >= min_docs, size)
            status = np.where(runs, FIRST, DROP)
            new = np.ones(len(key), dtype=bool)
            new[:sent] = False
            if sent:
                status[0] = DROP
            at_edge = key == opening
            status[at_edge] = EDGE
            last = begin[-1]
            settled = np.arange(len(key)) < last  # the last key may go on in the next batch
            yield emit(rows, status, new & ((settled & frequent) | at_edge | (~settled & frequent)))
            if at_edge[-1] or frequent[-1]:
                carried, sent = rows.slice(len(key) - 1), 1
            else:
                carried, sent = rows.slice(last), 0
        if carried is not None and not sent:  # the last key of the partition may go on in the next one
            n = carried.num_rows
            yield emit(carried, np.full(n, EDGE), np.ones(n, dtype=bool))

    return run


def shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """(doc_id, k2, pos) of the lines to drop: those of keys found in ``min_docs`` documents or more.

    ``keep="first"`` spares the first line of each key, by doc_id and position; ``"none"`` spares none.
    """
    if keep not in ("none", "first") or min_docs < 1:
        raise ValueError("keep is 'none' or 'first', min_docs at least 1")
    rows = line_rows(docs, min_chars)
    order = ["h", "doc_id", K2, "pos"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, T.StructField("status", T.IntegerType())])
    found = cut_lineage(ordered.mapInArrow(_stream(min_docs), schema))
    edges = found.where(F.col("status") == EDGE).select("h").distinct()
    # two keys a partition, so these fit a broadcast at any size of the input
    per_doc = found.join(F.broadcast(edges), "h").groupBy("h", "doc_id", K2).agg(F.min("pos").alias("pos"))
    settled = per_doc.groupBy("h").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", K2, "pos")).alias("first"))
    at_edge = found.where(F.col("status") == EDGE).join(F.broadcast(settled.where(F.col("docs") >= min_docs)), "h")
    inner = found.where(F.col("status") != EDGE)
    if keep == "first":
        at_edge = at_edge.where(~F.struct("doc_id", K2, "pos").eqNullSafe(F.col("first")))
        inner = inner.join(F.broadcast(settled.select("h", F.col("first"))), "h", "left").where(
            F.when(F.col("first").isNull(), F.col("status") == DROP)
            .otherwise(~F.struct("doc_id", K2, "pos").eqNullSafe(F.col("first")))
        )
    return inner.select("doc_id", K2, "pos").unionByName(at_edge.select("doc_id", K2, "pos"))


def pack(dropped: np.ndarray) -> bytes:
    """Compressed keep bitmap; lines beyond its end are kept."""
    keep = np.ones(int(dropped.max()) + 1, dtype=bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpack(packed: bytes, n_lines: int) -> np.ndarray:
    """The first ``n_lines`` flags of a bitmap; ``n_lines`` is the length it was packed with."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little").astype(bool)
    return bits[:n_lines]


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """(doc_id, k2, n, keep) of the documents that lose lines: compressed bitmaps of their first ``n`` lines, the rest is kept."""
    drops = shared_lines(docs, min_docs, min_chars, keep)
    listed = drops.groupBy("doc_id", K2).agg(F.collect_set("pos").alias("dropped"))
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField(K2, T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keep", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped = [np.array(x, dtype=np.int64) for x in batch.column("dropped").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column(K2), pa.array([int(x.max()) + 1 for x in dropped], pa.int32()), pa.array([pack(x) for x in dropped], pa.binary())],
                ["doc_id", K2, "n", "keep"],
            )

    return listed.mapInArrow(run, schema)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents without their dropped lines, all columns kept, with ``__llm_lines`` and ``__llm_dropped``."""
    right = bitmaps.select(
        F.col("doc_id").alias("__llm_id"), F.col(K2).alias("__llm_same"), F.col("n").alias("__llm_n"), F.col("keep").alias("__llm_keep")
    )
    keyed = with_key(docs)
    same = keyed["doc_id"].eqNullSafe(right["__llm_id"]) & (keyed[K2] == right["__llm_same"])
    joined = keyed.join(right, same, "left").select(*docs.columns, "__llm_n", "__llm_keep")
    schema = T.StructType([*docs.schema.fields, T.StructField("__llm_lines", T.LongType()), T.StructField("__llm_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            total = pc.add(pc.fill_null(pc.count_substring(text, "\n"), 0), 1)
            dropped = np.zeros(batch.num_rows, dtype=np.int64)
            rows = np.flatnonzero(batch.column("__llm_keep").is_valid().to_numpy(zero_copy_only=False))
            changed = []
            for r in rows:
                lines = text[r].as_py().split("\n")
                n = batch.column("__llm_n")[r].as_py()
                keep = np.ones(len(lines), dtype=bool)
                keep[:n] = unpack(batch.column("__llm_keep")[r].as_py(), n)
                changed.append("\n".join([line for line, k in zip(lines, keep) if k]))
                dropped[r] = len(lines) - int(keep.sum())
            if len(rows):
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[rows] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array(changed, text.type))
            columns = [text if f.name == "text" else batch.column(f.name) for f in docs_fields]
            yield pa.RecordBatch.from_arrays([*columns, total.cast(pa.int64()), pa.array(dropped)], names)

    docs_fields, names = list(docs.schema.fields), schema.names
    return joined.mapInArrow(run, schema)


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """The documents without shared lines; see :func:`shared_lines` and :func:`apply_bitmaps`."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep))
