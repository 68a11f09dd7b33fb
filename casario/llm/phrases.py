"""Collocations: phrases of two to five words that occur together more often than their parts would.

1. Tasks gather texts into chunks of one language. Words are counted, each chunk's own counts first.
2. Words that reach ``min_count`` are ranked by frequency, and chunks are written as the ranks of their word occurrences, with a gap
   for other words and where a piece ends. A chunk is many short rows, cut at gaps, as readers and Arrow batches hold thousands of rows at a time. Up to ``BROADCAST_ROWS`` ranks are broadcast. More of them meet the chunks, written with
   numbers of their own dictionaries, in a cogroup by chunk, so that neither side ever grows beyond a chunk.
3. Neighbours in a chunk are pairs of ranks. Ranks are split into tiles of ``TILE`` by ``TILE`` pairs: tiles of frequent ranks
   are counted by one dense ``bincount`` each, pairs of all other tiles are sorted and run-length counted.
   Pairs that reach ``min_count`` over all chunks are ranked in turn, and the chunks are written once more with these ranks
   instead, so that neighbours are now phrases of three words, which share their middle. So on to five words: a phrase
   can be frequent only if both phrases it is made of are.
4. A phrase's row names its first and last part, so the counts of all prefixes and suffixes follow from joins of
   these tables, which hold frequent phrases only. Scores are exact decimals.

Words are runs of bytes other than space, tab and ``PHRASE_ENDS``, A-Z lower-cased, and never cross documents. Null texts are empty; a
null language is ``und``. Rows that repeat count as often as they are there. Words are compared by 64-bit hashes. A language may
have up to 2^31 frequent phrases of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casario.llm.arrays import LOWER, PHRASE_ENDS, chunks, prefix_sums, slice_hashes, utf8, words
from casario.llm.frames import numbered
from casario.session import cut_lineage, scratch_path

CHUNK_BYTES, PART_BYTES = 4 << 20, 1 << 20
# Unfinished chunks that a task holds, one a language.
HELD_CHUNKS = 8
TILE_BITS = 10
TILE = 1 << TILE_BITS
# Ranks below this many tiles are counted densely, in tiles that are full enough.
DENSE_TILES = 4
FULL = TILE * TILE // 32
# Occurrences in a row of a chunk; one that has no gap for longer is longer.
ROW_IDS = 512
# Small row groups: a reader holds one of them at a time.
ROW_GROUP = str(16 << 20)

# So many ranks, of 16 bytes, are broadcast; more are joined.
BROADCAST_ROWS = 1 << 20

CHUNK_ROW = "chunk long, lang string, ids binary, code long, word string, n long"
COUNT_ROW = "lang string, word string, n long"
IDS_ROW = "chunk long, lang string, ids binary"
_32 = np.int64(32)


def spoken(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(hash, whether a piece starts, lower-cased bytes, first byte, end byte) of the words of a chunk."""
    data = np.concatenate(texts)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    ends_phrase = np.zeros(256, dtype=bool)
    ends_phrase[list(PHRASE_ENDS)] = True
    found = []
    for start, stop in chunks(offsets, PART_BYTES):
        base = offsets[start]
        part = data[base : offsets[stop]]
        hashes, owner, first, end = words(part, offsets[start : stop + 1] - base, "phrase")
        breaks = np.concatenate(([0], np.cumsum(ends_phrase[part], dtype=np.int32)))
        fresh = np.ones(len(hashes), dtype=bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (breaks[first[1:]] != breaks[first[:-1]])
        found.append((hashes, fresh, first + base, end + base))
    hashes, fresh, first, end = (np.concatenate(x) for x in zip(*found))
    return hashes.view(np.int64), fresh, LOWER[data], first, end


def found_ranks(codes: np.ndarray, ranks: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rank of each wanted code among sorted codes, or a gap."""
    if not len(codes):
        return np.full(len(wanted), -1, dtype=np.int32)
    place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[place] == wanted, ranks[place], -1).astype(np.int32)


def squeezed(ids: np.ndarray) -> np.ndarray:
    """Ranks with each run of gaps as one gap."""
    keep = ids >= 0
    keep[1:] |= ids[:-1] >= 0
    return ids[keep]


def cut_rows(ids: np.ndarray) -> pa.Array:
    """A chunk's ranks as short rows. Each starts with a gap, so that rows that are put together again, in any order, make no new neighbours."""
    ids = np.concatenate((np.full(1, -1, dtype=np.int32), squeezed(ids)))
    gaps = np.flatnonzero(ids < 0)
    firsts = gaps[np.unique(gaps // ROW_IDS, return_index=True)[1]]
    offsets = np.append(firsts, len(ids)) * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])


def joined_rows(rows: pa.Array) -> np.ndarray:
    """The ranks behind rows of a chunk."""
    start, end = np.frombuffer(rows.buffers()[1], np.int32)[[rows.offset, rows.offset + len(rows)]]
    return np.frombuffer(rows.buffers()[2], np.uint8)[start:end].view(np.int32)


def chunk_parts(batch: pa.RecordBatch) -> Iterator[tuple[int, str, np.ndarray]]:
    """(chunk, language, ranks) of the neighbouring rows of one chunk in a batch."""
    chunk = batch.column("chunk").to_numpy()
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(chunk), 1), dtype=bool), chunk[1:] != chunk[:-1])))
    for start, stop in zip(starts, np.append(starts[1:], len(chunk))):
        yield int(chunk[start]), batch.column("lang")[start].as_py(), joined_rows(batch.column("ids").slice(start, stop - start))


def ids_batch(chunk: int, lang: str, ids: np.ndarray) -> pa.RecordBatch:
    cut = cut_rows(ids)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), chunk), pa.int64()), pa.array([lang] * len(cut), pa.string()), cut], ["chunk", "lang", "ids"])


def spelt(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of a text as strings, gathered at once."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    letters = lower[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))


def hashes_of(found: pa.Array) -> np.ndarray:
    """The hashes that :func:`spoken` gives to lower-cased words."""
    data, offsets = utf8(found)
    parts = [slice_hashes(prefix_sums(data[offsets[a] : offsets[b]]), offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)


def count_rows(chunk: int, lang: str, texts: list[np.ndarray]) -> pa.RecordBatch:
    """(word, count) of each distinct word of a chunk."""
    hashes, _, lower, starts, ends = spoken(texts)
    distinct, first, n = np.unique(hashes, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(distinct), pa.string()), spelt(lower, starts[first], ends[first]), pa.array(n, pa.int64())], ["lang", "word", "n"]
    )


NOTHING = np.zeros(0, np.int64), np.zeros(0, np.int32)


def chunk_rows(known):
    """Makes the rows of a chunk: those of its occurrences, then its dictionary if that is needed.

    Occurrences are ranks where ``known`` broadcasts the ranks of hashes; else numbers of the chunk's own dictionary, which follows.
    """

    def rows_of(chunk: int, lang: str, texts: list[np.ndarray]) -> pa.RecordBatch:
        hashes, fresh, lower, starts, ends = spoken(texts)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if known is None:
            own, rows = np.arange(len(distinct), dtype=np.int32), len(distinct)
        else:
            own, rows = found_ranks(*known.value.get(lang, NOTHING), distinct), 0
        ids = cut_rows(np.insert(own[place], np.flatnonzero(fresh), np.int32(-1)))
        listed = spelt(lower, starts[first[:rows]], ends[first[:rows]])
        size, total = len(ids) + rows, np.zeros(len(ids) + rows, dtype=np.int64)
        total[0] = len(hashes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, chunk), pa.int64()), pa.array([lang] * size, pa.string()), pa.concat_arrays([ids, pa.nulls(rows, pa.binary())]),
                pa.array(np.arange(-len(ids), rows), pa.int64()), pa.concat_arrays([pa.nulls(len(ids), pa.string()), listed]), pa.array(total),
            ],
            ["chunk", "lang", "ids", "code", "word", "n"],
        )

    return rows_of


def _chunked(chunk_bytes: int, make):
    """Texts of a task gathered by language into chunks; the fullest goes first when too many bytes are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        made = 0

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            del size[lang]
            return make((task << 32) + made, lang, held.pop(lang))

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                if not len(text):
                    continue
                # a copy, so that what waits does not keep its batch alive
                held.setdefault(lang, []).append(text.copy())
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= chunk_bytes:
                    yield flush(lang)
                elif sum(size.values()) >= HELD_CHUNKS * chunk_bytes:
                    yield flush(max(size, key=size.get))
        for lang in list(held):
            yield flush(lang)

    return run


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, code) of all neighbours without a gap; the code holds both ranks."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, (ids[at].astype(np.int64) << _32) | ids[at + 1]


def count_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of pairs of ranks: dense tiles by bincount, all others sorted."""
    a, b = codes >> _32, codes & 0xFFFFFFFF
    ta, tb = a >> TILE_BITS, b >> TILE_BITS
    head = (ta < DENSE_TILES) & (tb < DENSE_TILES)
    tile = np.where(head, ta * DENSE_TILES + tb, -1)
    full = np.flatnonzero(np.bincount(tile[head], minlength=1) >= FULL)
    found, counts, sparse = [], [], np.ones(len(codes), dtype=bool)
    for t in full:
        mine = tile == t
        sparse &= ~mine
        cells = np.bincount((a[mine] & (TILE - 1)) * TILE + (b[mine] & (TILE - 1)), minlength=TILE * TILE)
        used = np.flatnonzero(cells)
        left, right = (t // DENSE_TILES) * TILE + (used >> TILE_BITS), (t % DENSE_TILES) * TILE + (used & (TILE - 1))
        found.append((left.astype(np.int64) << _32) | right)
        counts.append(cells[used])
    coo, n = np.unique(codes[sparse], return_counts=True)
    return np.concatenate([*found, coo]), np.concatenate([*counts, n])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, lang, ids in chunk_parts(batch):
            codes, n = count_codes(neighbours(ids)[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(codes), chunk), pa.int64()), pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())],
                ["chunk", "lang", "code", "n"],
            )


def _broadcast_ranks(known):
    """Chunks with the ranks of the pairs that start at each place, from broadcast ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, ids in chunk_parts(batch):
                out = np.full(len(ids), -1, dtype=np.int32)
                at, wanted = neighbours(ids)
                out[at] = found_ranks(*known.value.get(lang, NOTHING), wanted)
                yield ids_batch(chunk, lang, out)

    return run


def _joined_ranks(paired: bool):
    """Chunks with the ranks of their words, or of the pairs that start at each place, which are the other side."""

    def run(key: tuple, chunk: pa.Table, ranks: pa.Table) -> pa.Table:
        schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("ids", pa.binary())])
        if not chunk.num_rows or not ranks.num_rows:
            return schema.empty_table()
        ids = np.concatenate([joined_rows(part) for part in chunk.column("ids").chunks])
        codes, rank = ranks.column("code").to_numpy(), ranks.column("id").to_numpy()
        order = np.argsort(codes)
        at, wanted = neighbours(ids) if paired else (np.flatnonzero(ids >= 0), ids[ids >= 0].astype(np.int64))
        out = np.full(len(ids), -1, dtype=np.int32)
        out[at] = found_ranks(codes[order], rank[order], wanted)
        return pa.Table.from_batches([ids_batch(key[0].as_py(), chunk.column("lang")[0].as_py(), out)], schema)

    return run


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranked(counted: DataFrame, key: str, min_count: int) -> DataFrame:
    """(lang, key, f, id) of what reaches ``min_count``, the most frequent of a language first from 0."""
    often = counted.groupBy("lang", key).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    return numbered(often, "lang", "id", [F.col("lang"), F.desc("f"), F.col(key)])


def _broadcast(ranked: DataFrame, key: str, most_rows: int):
    """Ranks by language and sorted code, which is the hash of a word, as a broadcast; None if there are more than ``most_rows``."""
    if ranked.count() > most_rows:
        return None
    table, known = ranked.select("lang", key, "id").toArrow().combine_chunks(), {}
    for lang in table.column("lang").unique().to_pylist():
        part = table.filter(pc.equal(table.column("lang"), lang)).combine_chunks()
        keys = part.column(key)
        codes = hashes_of(pa.concat_arrays(keys.chunks)) if key == "word" else keys.to_numpy()
        order = np.argsort(codes)
        known[lang] = codes[order], part.column("id").to_numpy()[order].astype(np.int32)
    return ranked.sparkSession.sparkContext.broadcast(known)


def _met(chunked: DataFrame, hits: DataFrame, paired: bool) -> DataFrame:
    """The chunks with the ranks that ``hits`` (of, code, id) names for their codes."""
    sides = chunked.select("chunk", "lang", "ids").groupBy("chunk").cogroup(hits.groupBy("of"))
    return _written(sides.applyInArrow(_joined_ranks(paired), IDS_ROW), "chunks")


def _hits(codes: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    return codes.join(ranked.select("lang", key, "id"), ["lang", key]).select(F.col("chunk").alias("of"), "code", "id")


def _id_codes(code: Column) -> tuple[Column, Column]:
    return F.shiftright(code, 32), code.bitwiseAND(F.lit(0xFFFFFFFF))


def frequent_phrases(
    docs: DataFrame, min_count: int = 100, most_words: int = 5, broadcast_rows: int = BROADCAST_ROWS, chunk_bytes: int = CHUNK_BYTES
) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n) of all words, then for 1 to ``most_words`` words the (lang, id, f, phrase, last, prefixes, suffixes, a, b)).

    ``prefixes`` and ``suffixes`` are the counts of the leading and trailing parts of 1, 2, ... words; ``a`` and ``b`` number
    the phrases without the last and without the first word.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    ranked = cut_lineage(_ranked(texts.mapInArrow(_chunked(chunk_bytes, count_rows), COUNT_ROW), "word", min_count))
    known = _broadcast(ranked, "word", broadcast_rows)
    rows = _written(texts.mapInArrow(_chunked(chunk_bytes, chunk_rows(known)), CHUNK_ROW), "chunks")
    chunked = rows.where(F.col("ids").isNotNull())
    totals = cut_lineage(chunked.groupBy("lang").agg(F.sum("n").alias("n")))
    if known is None:
        chunked = _met(chunked, _hits(rows.where(F.col("word").isNotNull()), ranked, "word"), paired=False)
    empty, no_id, word = F.array().cast("array<long>"), F.lit(None).cast("long"), F.col("word")
    levels = [cut_lineage(ranked.select(
        "lang", "id", "f", word.alias("phrase"), word.alias("last"), empty.alias("prefixes"), empty.alias("suffixes"), no_id.alias("a"), no_id.alias("b")
    ))]
    for size in range(2, most_words + 1):
        pairs = chunked.select("chunk", "lang", "ids").mapInArrow(_pairs, "chunk long, lang string, code long, n long")
        ranked = cut_lineage(_ranked(pairs.select("lang", "code", "n"), "code", min_count))
        a, b = _id_codes(F.col("code"))
        left, right = (levels[-1].select("lang", F.col("id").alias(k), F.struct("f", "phrase", "last", "prefixes", "suffixes").alias(f"part_{k}")) for k in "ab")
        levels.append(cut_lineage(
            ranked.withColumns({"a": a, "b": b}).join(left, ["lang", "a"]).join(right, ["lang", "b"]).select(
                "lang", "id", "f", F.concat_ws(" ", "part_a.phrase", "part_b.last").alias("phrase"), F.col("part_b.last").alias("last"),
                F.concat("part_a.prefixes", F.array("part_a.f")).alias("prefixes"),
                F.concat("part_b.suffixes", F.array("part_b.f")).alias("suffixes"), "a", "b",
            )
        ))
        if size < most_words:
            known = _broadcast(ranked, "code", broadcast_rows)
            if known is None:
                chunked = _met(chunked, _hits(pairs, ranked, "code"), paired=True)
            else:
                chunked = _written(chunked.select("chunk", "lang", "ids").mapInArrow(_broadcast_ranks(known), IDS_ROW), "chunks")
    return totals, levels


def _uncovered(level: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases of ``shorter`` that some phrase of one more word does not always hold.

    A longer one that holds a phrase as often holds it through one of one more word, which is as frequent.
    """
    of = [
        level.select("lang", F.col(k).alias("id"), F.col("f").alias("longer")) for k in ("a", "b")
    ]
    most = of[0].union(of[1]).groupBy("lang", "id").agg(F.max("longer").alias("longer"))
    return shorter.join(most, ["lang", "id"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).drop("longer")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, score, k, a, l, r, n) of the weakest cut of each phrase, the first of equal ones; decimals of 38 digits keep it exact."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = found.select(
        "lang", "phrase", F.col("f").alias("a"), "n", F.posexplode(F.arrays_zip("prefixes", F.reverse("suffixes").alias("suffixes"))).alias("k", "cut")
    ).select("lang", "phrase", "a", "n", "k", F.col("cut.prefixes").alias("l"), F.col("cut.suffixes").alias("r"))
    above, below = (exact("a") * exact("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), exact("l") * exact("r")
    weighed = cuts.withColumns({"above": above.cast("decimal(38,0)"), "below": below.cast("decimal(38,0)")}).withColumn("score", F.expr("above div below"))
    return weighed.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")


def collocations(
    docs: DataFrame, min_count: int = 100, most_words: int = 5, top: int = 2000, broadcast_rows: int = BROADCAST_ROWS, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all words of the language;
    the score is floor(1000 a n / (l r)) at that cut. Phrases that a longer one always holds are left out.
    """
    if most_words < 2:
        raise ValueError("phrases have at least two words")
    totals, levels = frequent_phrases(docs, min_count, most_words, broadcast_rows, chunk_bytes)
    kept = [_uncovered(longer, level) for level, longer in zip(levels[1:], levels[2:])] + levels[-1:]
    found = kept[0].select("lang", "phrase", "f", "prefixes", "suffixes")
    for level in kept[1:]:
        found = found.unionByName(level.select(*found.columns))
    lowest = scored(found.join(totals, "lang"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return lowest.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
