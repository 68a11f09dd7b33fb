"""Personal data: fixed patterns, and terms that reveal a protected value by the corpus's own statistics.

A protected value is an address or number found by pattern, or the class that it belongs to: the domain of an address,
the network of an ip, the leading digits of a card or phone. A word of a document is one that stands outside such
values, wherever in the text. Over all texts, words and values are counted: a word reveals a value if it makes
the value likely where it was not,

    log2( P(value | word) / P(value) ) >= ``LEAST_BITS``   and   P(value | word) >= ``GENERALISE``,

with probabilities as shares of distinct texts and at least ``LEAST_DOCS`` distinct texts that hold both: copies of a text are
no further evidence. Every document is counted, and one text of each group of equal ones is counted again with the
negative number of the others, so that only copied texts are shuffled. A revealing word is
generalised to its shape in every place of every document, with or without the value, or removed if
P(value | word) >= ``REMOVE``. A word that stands with a value once proves nothing; a name that goes with one address
wherever it occurs gives the person away.

Null texts are empty. Repeated rows are copies. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casario.llm.arrays import chunks, utf8, words
from casario.llm.frames import K2, with_key
from casario.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")
LEAST_DOCS, LEAST_BITS, GENERALISE, REMOVE = 3, 4.0, 0.5, 0.9
# Values or terms sent to the tasks at once; more make more passes, whose results add up.
BLOCK_ROWS = 2_000_000
# So many of the most common terms are known to the tasks, which leave out pairs that their counts rule out.
COMMON_TERMS = 200_000
# Pairs a task hands on at once.
PAIRS = 1 << 18

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs of digits are taken whole, so neither pattern can backtrack into one.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_CANDIDATE = re.compile("[0-9@]")

Span = tuple[str, int, int]

BASE_SCHEMA = (
    "doc_id {id}, " + K2 + " long, text string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans array<struct<kind:string,start:long,end:long>>, term_spans array<struct<kind:string,start:long,end:long>>"
)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_DOCUMENT, _VALUE, _TERM = range(3)  # what is counted


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds exactly one @ after its local part, so each @ is tried once, with all allowed characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _small(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind, then start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def value_number(kind: str, raw: str) -> int:
    """64-bit number of a protected value, whatever its separators and case."""
    plain = raw.lower() if kind in ("email", "ip") else _NOT_DIGIT.sub("", raw)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def found_spans(text: str) -> list[Span]:
    return base_spans(text) if _CANDIDATE.search(text) else []


def value_class(kind: str, raw: str) -> int:
    """Number of what values of one owner share: domain, network, leading digits."""
    if kind == "email":
        return value_number(kind, raw.rpartition("@")[2])
    if kind == "ip":
        return value_number(kind, raw.rpartition(".")[0] + ".")
    return value_number(f"{kind} class", _NOT_DIGIT.sub("", raw)[:6])


def value_numbers(text: str, spans: list[Span]) -> np.ndarray:
    """Numbers of all values of a text and of their classes."""
    found = {(kind, text[a:b]) for kind, a, b in spans}
    return np.array(sorted({number(*value) for value in found for number in (value_number, value_class)}), dtype=np.int64)


def free_words(column: pa.Array) -> Iterator[tuple[str, list[Span], np.ndarray, np.ndarray, np.ndarray]]:
    """(text, spans of values, word hashes, starts, ends) of each text; words that touch a value are left out."""
    data, offsets = utf8(column)
    for first, stop in chunks(offsets):
        part = data[offsets[first] : offsets[stop]]
        edges = offsets[first : stop + 1] - offsets[first]
        hashes, owner, begin, end = words(part, edges)
        points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        bounds = np.searchsorted(owner, np.arange(stop - first + 1))
        for k in range(stop - first):
            text = column[first + k].as_py() or ""
            mine = slice(bounds[k], bounds[k + 1])
            terms, starts, ends = hashes[mine].view(np.int64), points[begin[mine]] - points[edges[k]], points[end[mine]] - points[edges[k]]
            if spans := found_spans(text):
                free = np.ones(len(terms), dtype=bool)
                for _, a, b in spans:
                    free[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = False
                terms, starts, ends = terms[free], starts[free], ends[free]
            yield text, spans, terms, starts, ends


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, spans = {k: [] for k in KINDS}, [], []
        for cell in batch.column("text"):
            found = found_spans(cell.as_py() or "")
            for kind in KINDS:
                counts[kind].append(sum(s[0] == kind for s in found))
            digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest())
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column(K2), batch.column("text"), *(pa.array(counts[k], pa.int64()) for k in KINDS),
                pa.array(digests, pa.string()), pa.array(spans, _SPANS), pa.array([[]] * len(batch), _SPANS),
            ],
            ["doc_id", K2, "text", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "term_spans"],
        )


def weighed_texts(docs: DataFrame) -> DataFrame:
    """(text, weight): every document with 1, and one text of each group of m equal ones with 1 - m."""
    same = F.struct(F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"))
    texts = docs.select("text", same.alias("same"))
    copied = cut_lineage(texts.groupBy("same").agg(F.count("*").alias("m")).where("m > 1"))
    once = texts.join(copied, "same").groupBy("same", "m").agg(F.min("text").alias("text"))
    return texts.select("text", F.lit(1).cast("long").alias("weight")).unionByName(
        cut_lineage(once.select("text", (1 - F.col("m")).alias("weight")))
    )


def _added(numbers: np.ndarray, docs: np.ndarray, each: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by number, with the weight of each of the new arrays that holds it."""
    all_numbers = np.concatenate((numbers, *(found for found, _ in each)))
    weights = np.concatenate((docs, *(np.full(len(found), weight) for found, weight in each)))
    numbers, where = np.unique(all_numbers, return_inverse=True)
    return numbers, np.bincount(where, weights=weights, minlength=len(numbers)).astype(np.int64)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, number, docs) of each batch: its documents, and every value and word of every text, once a document, by weight."""
    for batch in batches:
        known = {what: (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for what in (_VALUE, _TERM)}
        each: dict[int, list[tuple[np.ndarray, int]]] = {what: [] for what in known}
        held = 0
        weights = batch.column("weight").to_pylist()
        for weight, (text, spans, terms, _, _) in zip(weights, free_words(batch.column("text"))):
            distinct = np.unique(terms)
            each[_TERM].append((distinct, weight))
            if spans:
                each[_VALUE].append((value_numbers(text, spans), weight))
            held += len(distinct)
            if held > PAIRS:
                known, each, held = {w: _added(*known[w], each[w]) if each[w] else known[w] for w in known}, {w: [] for w in known}, 0
        known = {w: _added(*known[w], each[w]) if each[w] else known[w] for w in known}
        for what, (numbers, docs) in [(_DOCUMENT, (np.zeros(1, np.int64), np.array([sum(weights)]))), *known.items()]:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), what, np.int32)), pa.array(numbers), pa.array(docs)], ["what", "number", "docs"])


def _blocks(rows: DataFrame, key: str, most: int) -> Iterator[dict[str, np.ndarray]]:
    """The rows as columns in blocks of about ``most``, each sorted by a key of whole numbers; no block if there is no row."""
    blocks = -(-rows.count() // most)
    for block in range(blocks):
        got = rows.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).toArrow().sort_by(key)
        yield {name: got.column(name).to_numpy() for name in got.column_names}


def _place(numbers: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each number among known, sorted ones, and whether it is one of them."""
    if not len(known):
        return np.zeros(len(numbers), dtype=np.int64), np.zeros(len(numbers), dtype=bool)
    at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
    return at, known[at] == numbers


def _pairs(values, common):
    """(value, term, weight) of each document, for the values of a block; terms too common to reveal the value are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often = values.value, common.value
        for batch in batches:
            for weight, (text, spans, terms, _, _) in zip(batch.column("weight").to_pylist(), free_words(batch.column("text"))):
                if not spans:
                    continue
                mine = value_numbers(text, spans)
                at, held = _place(mine, frequent["number"])
                if not held.any():
                    continue
                terms = np.unique(terms)
                where, known = _place(terms, often["number"])
                docs = np.where(known, often["docs"][where], 0) if len(often["number"]) else np.zeros(len(terms), dtype=np.int64)
                for value, of_value in zip(mine[held], frequent["docs"][at[held]]):
                    # P(value | term) is at most of_value / of_term
                    left = terms[docs * GENERALISE <= of_value]
                    for k in range(0, len(left), PAIRS):
                        some = left[k : k + PAIRS]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), value)), pa.array(some), pa.array(np.full(len(some), weight, np.int64))], ["value", "term", "weight"]
                        )

    return run


def revealing(docs: DataFrame, block_rows: int = BLOCK_ROWS, common_terms: int = COMMON_TERMS) -> DataFrame:
    """(value, term, action) of the words that give a value away; see the module's text for the rule."""
    spark = docs.sparkSession
    weighed = weighed_texts(docs)
    counts = cut_lineage(
        weighed.mapInArrow(_document_counts, "what int, number long, docs long").groupBy("what", "number")
        .agg(F.sum("docs").alias("docs")).where((F.col("what") == _DOCUMENT) | (F.col("docs") >= LEAST_DOCS))
    )
    total = counts.where(F.col("what") == _DOCUMENT).agg(F.sum("docs")).first()[0] or 0
    values, terms = (counts.where(F.col("what") == what).select("number", "docs") for what in (_VALUE, _TERM))
    often = terms.orderBy(F.desc("docs"), "number").limit(common_terms).toArrow().sort_by("number")
    common = spark.sparkContext.broadcast({name: often.column(name).to_numpy() for name in often.column_names})
    pairs = spark.createDataFrame([], "value long, term long, weight long")
    texts = weighed.where(F.col("text").rlike(_CANDIDATE.pattern))
    for block in _blocks(values, "number", block_rows):
        pairs = pairs.union(texts.mapInArrow(_pairs(spark.sparkContext.broadcast(block), common), "value long, term long, weight long"))
    together = pairs.groupBy("value", "term").agg(F.sum("weight").alias("both")).where(F.col("both") >= LEAST_DOCS)
    share = F.col("both") / F.col("of_term")
    bits = F.log2(share * F.lit(float(max(total, 1))) / F.col("of_value"))
    return together.join(values.toDF("value", "of_value"), "value").join(terms.toDF("term", "of_term"), "term").where(
        (share >= GENERALISE) & (bits >= LEAST_BITS)
    ).select("value", "term", F.when(share >= REMOVE, "remove").otherwise("generalise").alias("action"))


def _marks(told, names: list[str]):
    """Adds the places of a block of revealing terms to ``term_spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = told.value
        for batch in batches:
            marks = batch.column("term_spans").to_pylist()
            for k, (_, _, terms, starts, ends) in enumerate(free_words(batch.column("text"))):
                at, hit = _place(terms, block["term"])
                if hit.any():
                    new = zip(block["remove"][at[hit]].tolist(), starts[hit].tolist(), ends[hit].tolist())
                    marks[k] = sorted(
                        [*marks[k], *({"kind": TERM_KINDS[r], "start": a, "end": b} for r, a, b in new)], key=lambda s: (s["kind"], s["start"])
                    )
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, _SPANS) if n == "term_spans" else batch.column(n) for n in names], names
            )

    return run


def private_spans(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, k2, counts, base_sha256, spans, term_spans) of every document.

    ``spans`` are those of the patterns; ``term_spans`` those of revealing words, of kind ``generalise`` or ``remove``.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = cut_lineage(
        revealing(docs, block_rows).groupBy("term").agg(F.max((F.col("action") == "remove").cast("int")).alias("remove"))
    )
    schema = BASE_SCHEMA.format(id=kind)
    out = with_key(docs.select("doc_id", "text")).select("doc_id", K2, "text").mapInArrow(_base, schema)
    for block in _blocks(told, "term", block_rows):
        out = out.mapInArrow(_marks(spark.sparkContext.broadcast(block), out.columns), schema)
    return out.select("doc_id", K2, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "term_spans")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def shape(term: str) -> str:
    """What is left of a generalised word: letters become x or X, digits 0, runs are shortened."""
    mapped = re.sub(r"\d", "0", re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", term))
    return re.sub(r"(.)\1+", r"\1", mapped)


def sanitised(text: str, spans: list[Span]) -> str:
    """Text with values replaced by their kind, revealing words by their shape or nothing. Overlapping spans become one, named by the first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= done:
            out.append(text[done:start])
            out.append(shape(text[start:end]) if kind == "generalise" else "" if kind == "remove" else f"<{kind}>")
        done = max(done, end)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data taken out of their texts, all columns kept."""
    found = private_spans(docs).where((F.size("spans") > 0) | (F.size("term_spans") > 0)).select(
        F.col("doc_id").alias("__llm_id"), F.col(K2).alias("__llm_same"), F.concat("spans", "term_spans").alias("__llm_spans")
    ).dropDuplicates(["__llm_id", "__llm_same"])
    joined = with_key(docs).join(
        found, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col(K2) == F.col("__llm_same")), "left"
    ).select(*docs.columns, "__llm_spans")
    schema = T.StructType(list(docs.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t if not s else sanitised(t, [(x["kind"], x["start"], x["end"]) for x in s])
                for t, s in zip(batch.column("text").to_pylist(), batch.column("__llm_spans").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema.fields], schema.names
            )

    return joined.mapInArrow(run, schema)
