"""Fill-in-the-middle: texts cut at token edges and put in another order, reversibly.

Tokens are runs of A-Z and a-z, and single code points otherwise. A chunk of UTF-8 is viewed as 64-bit words and
the bytes that end a token are marked by arithmetic on whole words: a byte ends one unless a continuation byte
follows or both it and the next are letters. Marks per word are counted, so the k-th token end is found by
a search in the running counts and one multiplication inside the word.

Prefix and middle end after the smaller and the larger of two draws; the rest is the suffix. Draws are the leading 8-digit groups of
the SHA-256 of ``seed:id``, so they depend on the row alone. A null id draws as an empty one. A text that is null or empty, or
holds a marker, stays plain, as does the share that a draw leaves plain. Rows that repeat get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casario.llm.arrays import chunks, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_P, _S, _M = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
ONES = np.uint64(0x0101010101010101)
HIGH, LOW = ONES * np.uint64(0x80), ONES * np.uint64(0x7F)
CASE, FROM_A, PAST_Z = (ONES * np.uint64(k) for k in (0x20, 0x80 - 0x61, 0x80 - 0x7B))
_1, _3, _7, _8, _56 = (np.uint64(k) for k in (1, 3, 7, 8, 56))


class Marks:
    """Marked bytes of a chunk, the top bit of each: how many lie before a place, and where the k-th ends."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Marked bytes before each place."""
        word = places >> 3
        below = (_1 << ((places & 7).astype(np.uint64) << _3)) - _1
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def end(self, k: np.ndarray) -> np.ndarray:
        """The place behind the k-th marked byte, from 1."""
        word = np.minimum(np.searchsorted(self.before, k, side="left"), len(self.words)) - 1
        within = (k - self.before[word]).astype(np.uint64)
        # byte j of the product counts the marks of bytes 0 to j
        counts = (self.words[word] >> _7) * ONES
        reached = ((counts | HIGH) - within * ONES) & HIGH
        return word * 8 + 9 - np.bitwise_count(reached)


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks]:
    """(last bytes of tokens, last bytes of code points) of a chunk of documents; tokens never cross documents."""
    padded = np.zeros((len(data) // 8 + 2) * 8, dtype=np.uint8)
    padded[: len(data)] = data
    w = padded.view("<u8")

    def following(flags: np.ndarray) -> np.ndarray:
        out = flags >> _8
        out[:-1] |= flags[1:] << _56
        return out

    low = (w | CASE) & LOW
    letter = (low + FROM_A) & ~(low + PAST_Z) & ~w & HIGH
    points = HIGH & ~following(w & ~(w << _1))
    tokens = points & ~(letter & following(letter))
    last = offsets[1:][np.diff(offsets) > 0] - 1
    for flags in (points, tokens):
        by_byte = flags.view(np.uint8)
        by_byte[last] = 0x80
        by_byte[len(data) :] = 0
    return Marks(tokens), Marks(points)


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for start, stop in chunks(offsets):
                rows = batch.slice(start, stop - start)
                part = offsets[start : stop + 1] - offsets[start]
                text = data[offsets[start] : offsets[stop]]
                tokens, points = marks(text, part)
                first = tokens.rank(part)
                n = np.diff(first)
                cuts = np.sort(np.stack([rows.column(f"__llm_h{k}").to_numpy() % (n + 1) for k in (1, 2)]), axis=0)
                ends = np.where(cuts > 0, tokens.end(first[:-1] + np.maximum(cuts, 1)), part[:-1])
                counted = points.rank(np.vstack([part[:-1], ends]))
                raw = text.tobytes()
                forms, outputs = [], []
                for k, form in enumerate(rows.column("__llm_form").to_pylist()):
                    a, b, c, d = int(part[k]), int(ends[0, k]), int(ends[1, k]), int(part[k + 1])
                    whole = raw[a:d]
                    if not whole or _P in whole or _S in whole or _M in whole:
                        form = "plain"
                    before, middle, after = _P + raw[a:b], _M + raw[b:c], _S + raw[c:d]
                    forms.append(form)
                    outputs.append({"plain": whole, "psm": before + after + middle, "spm": after + before + middle}[form])
                plain = np.array([f == "plain" for f in forms], dtype=bool)
                spans = [pa.array(np.diff(counted, axis=0)[k], pa.int64(), mask=plain) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in names), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *spans,
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    [*names, "__llm_tokens", "__llm_form", "__llm_prefix", "__llm_middle", "__llm_output"],
                )

    return run


def draws(seed: str, row_id: Column) -> list[Column]:
    """Four numbers below 2^32 for a row, the same wherever it lies."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", id_col: str = "doc_id", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``docs`` with ``__llm_output`` and its ``__llm_form`` (``plain``, ``psm`` or ``spm``); no row moves.

    ``__llm_tokens`` counts the tokens, ``__llm_prefix`` and ``__llm_middle`` the code points of these parts (null if plain).
    """
    h = draws(seed, F.col(id_col))
    form = F.when(h[2] % 100 >= 100 - plain_percent, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    drawn = docs.withColumns({"__llm_h1": h[0], "__llm_h2": h[1], "__llm_form": form})
    schema = T.StructType([
        *docs.schema.fields, T.StructField("__llm_tokens", T.LongType()), T.StructField("__llm_form", T.StringType()),
        T.StructField("__llm_prefix", T.LongType()), T.StructField("__llm_middle", T.LongType()), T.StructField("__llm_output", T.StringType()),
    ])
    return drawn.mapInArrow(_cut(list(docs.columns)), schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text behind an output. Parts hold no marker, so the first of each ends the part before it."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(F.substr(output, F.lit(len(first) + 1)), second, 1)
        rest = F.substr(output, F.length(one) + len(first) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    swapped, before, between = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, between, swapped)).otherwise(output)
