"""Chat formatting: one text and one loss mask per conversation, assembled as columns of bytes.

Template, for each turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. The loss mask covers
the texts of the assistant. Control strings inside texts and roles are broken by one backslash after
their first character; such strings that already hold backslashes there get one more, so that
removing one gives every text back.

A text with a null is empty, as is a null role. Turns come by number, nulls first, then by role and text; repeated
rows are repeated turns. A conversation is one output row, so its turns meet in one task: that is the unit of output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casario.llm.arrays import utf8

OPEN, CLOSE, LEARNED = "<|im_start|>", "<|im_end|>", "assistant"
# Strings that common chat templates give a meaning to; none survives inside a text.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_BROKEN = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS)
_ESCAPE = re.compile(f"(?={_BROKEN})(.)", re.DOTALL)
_UNESCAPE = re.compile("(?=" + "|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS) + r")(.)\\", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)

FORMATTED = "conv_id {id}, n_turns long, formatted string, mask array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _role(role: str) -> str:
    """Roles lie on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_back(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _escaped(column: pa.Array, one) -> pa.Array:
    """``one`` applied to the few values that need it."""
    column = pc.fill_null(column, "")
    odd = pc.match_substring_regex(column, r"[<\[%\n]" if one is _role else r"[<\[]")
    if not pc.any(odd).as_py():
        return column
    return pc.replace_with_mask(column, odd, pa.array([one(v.as_py()) for v in column.filter(odd)], column.type))


def assemble(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleaves columns of byte strings: (bytes, offsets of rows, offsets of all segments).

    Lengths of all segments give cumulative offsets; these give, for each byte, its place in
    the one output buffer.
    """
    rows, width = len(parts[0][1]) - 1, len(parts)
    lengths = np.stack([np.diff(offsets) for _, offsets in parts], axis=1)
    segments = np.concatenate(([0], np.cumsum(lengths.ravel())))
    out = np.empty(int(segments[-1]), dtype=np.uint8)
    for k, (data, offsets) in enumerate(parts):
        shift = segments[:-1].reshape(rows, width)[:, k] - offsets[:-1]
        out[np.arange(len(data)) + np.repeat(shift, lengths[:, k])] = data
    return out, segments[::width], segments.reshape(-1)


def _constant(text: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return np.tile(raw, rows), np.arange(rows + 1) * len(raw)


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def format_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Conversations (conv_id, turns) to (conv_id, n_turns, formatted, mask)."""
    turns = batch.column("turns")
    bounds = turns.offsets.to_numpy() - turns.offsets[0].as_py()
    flat = turns.flatten()
    roles, texts = flat.field("role"), flat.field("text")
    rows = len(flat)
    parts = [
        _constant(OPEN, rows), utf8(_escaped(roles, _role)), _constant("\n", rows),
        utf8(_escaped(texts, escape)), _constant(CLOSE + "\n", rows),
    ]
    out, ends, segments = assemble(parts)
    conv = ends[bounds]
    if conv[-1] >= 2**31:
        raise ValueError("a batch holds over 2 GB of text: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    formatted = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(conv.astype(np.int32)), pa.py_buffer(out))
    learned = np.flatnonzero(pc.fill_null(pc.equal(roles, LEARNED), False).to_numpy(zero_copy_only=False))
    at = _points(out)
    owner = np.searchsorted(bounds, learned, side="right") - 1
    base = at[conv[owner]]
    mask = pa.StructArray.from_arrays(
        [pa.array(at[segments[5 * learned + 3]] - base), pa.array(at[segments[5 * learned + 4]] - base)], ["start", "end"]
    )
    per = np.searchsorted(learned, bounds).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column("conv_id"), pa.array(np.diff(bounds).astype(np.int64)), formatted, pa.ListArray.from_arrays(pa.array(per), mask)],
        ["conv_id", "n_turns", "formatted", "mask"],
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, mask) of turns (conv_id, turn, role, text).

    ``mask`` lists spans of code points of ``formatted`` that a loss counts.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield format_batch(batch.slice(start, 256))

    return ordered.mapInArrow(run, FORMATTED.format(id=kind))


def read_chat(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(_role_back(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, turns, chars, loss, points = [], [], [], [], []
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()):
            back = read_chat(text)
            learned = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
            n.append(len(back))
            turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest())
            chars.append(len(learned))
            loss.append(hashlib.sha256(learned.encode()).hexdigest())
            points.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *map(pa.array, (np.array(n, np.int64),)), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(points, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back; sums up their turns and what the loss mask covers."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        _digests,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
