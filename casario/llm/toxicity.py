"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, word pairs and pairs with up to two words between them, hashed to 2^20 places.
Presence, not frequency, so that a few words count as much in a long text as in a short one. FTRL keeps a learning rate
per coordinate and sets weights to exactly zero unless the evidence exceeds the L1 term; the few weights left are
one table of fixed size that is broadcast to the scoring tasks.

The model is fitted by one task on a bounded sample: the ``SAMPLE_ROWS`` labelled texts of least id hash. Labels other than 0
and 1 are ignored; a text labelled twice is two examples. Without examples of both labels all scores are the prior.
Null and empty texts have no features and score by the bias alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casario.llm.arrays import chunks, mix, utf8, words

BITS = 20
SAMPLE_ROWS = 12_000
SKIPS = 2
EPOCHS = 8
# Places that fewer examples have are left out of the fit: they would learn single texts by heart.
LEAST_EXAMPLES = 5
# A high rate with strong L1: what is left are a few hundred weights that are each worth a decision.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 6.0, 0.0


def features(hashes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, document) of words, then of pairs with 0 to ``SKIPS`` words between."""
    shift = np.uint64(64 - BITS)
    yield (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> shift).astype(np.int64), owner
    for gap in range(1, SKIPS + 2):
        if len(hashes) <= gap:
            return
        same = owner[gap:] == owner[:-gap]
        pair = mix(hashes[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + hashes[gap:][same] * np.uint64(2 * gap + 1))
        yield (pair >> shift).astype(np.int64), owner[gap:][same]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for start, stop in chunks(offsets):
            part = offsets[start : stop + 1]
            hashes, owner, _, _ = words(data[part[0] : part[-1]], part - part[0])
            place, doc = map(np.concatenate, zip(*features(hashes, owner)))
            both = np.unique(doc << BITS | place)
            bounds = np.searchsorted(both >> BITS, np.arange(stop - start + 1)).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(bounds), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(start, stop - start) for c in ("order", "label")), column], ["order", "label", "places"]
            )


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) after FTRL-proximal passes over (places, label)."""
    size = 1 << BITS
    seen = np.zeros(size, dtype=np.int32)
    for at, _ in examples:
        seen[at] += 1
    examples = [(at[seen[at] >= LEAST_EXAMPLES], y) for at, y in examples]
    z, n = np.zeros(size), np.zeros(size)
    labels = np.array([y for _, y in examples], dtype=float)
    if not len(labels) or labels.min() == labels.max():
        prior = (labels.sum() + 0.5) / (len(labels) + 1)
        return np.zeros(size, dtype=np.float32), float(np.log(prior / (1 - prior)))
    bias, bias_n = float(np.log(labels.mean() / (1 - labels.mean()))), 0.0
    for _ in range(epochs):
        for at, y in examples:
            zs, ns = z[at], n[at]
            root = np.sqrt(ns)
            w = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            n[at] = ns + g * g
            z[at] = zs + g - (np.sqrt(ns + g * g) - root) / ALPHA * w
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    weights = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return weights.astype(np.float32), bias


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples: list[tuple[np.ndarray, int]] = []
    for batch in batches:
        bounds, flat = batch.column("places").offsets.to_numpy(), batch.column("places").values.to_numpy()
        labels = batch.column("label").to_pylist()
        examples += [(flat[a:b].copy(), y) for a, b, y in zip(bounds[:-1], bounds[1:], labels)]
    weights, bias = fit(examples)
    kept = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(kept, -1).astype(np.int32)), pa.array(np.append(weights[kept], bias).astype(np.float64))], ["place", "weight"]
    )


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weights from (doc_id, label) rows and the texts of these documents."""
    known = (
        labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("order"))
        .orderBy("order", "doc_id", "label").limit(sample_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("order", "label", "text")
    rows = texts.mapInArrow(_featurise, "order long, label int, places array<int>")
    model = rows.repartition(1).sortWithinPartitions("order", "label", F.size("places")).mapInArrow(_fit_task, "place int, weight double").collect()
    weights, bias = np.zeros(1 << BITS, dtype=np.float32), 0.0
    for place, weight in model:  # at most 2^BITS, in practice some hundreds
        if place < 0:
            bias = weight
        else:
            weights[place] = weight
    return weights, bias


def score_chunk(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Score of each document of a chunk."""
    hashes, owner, _, _ = words(data, offsets)
    found = [np.zeros(0, dtype=np.int64)]
    for place, doc in features(hashes, owner):
        some = weights[place] != 0
        found.append(doc[some] << BITS | place[some])
    both = np.unique(np.concatenate(found))
    total = np.bincount(both >> BITS, weights=weights[both & ((1 << BITS) - 1)], minlength=len(offsets) - 1) + bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, bias: float, into: str = "__llm_score") -> DataFrame:
    """``docs`` with the score of each text, from 0 to 1."""
    model = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(weights), weights[weights != 0], bias))
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, bias_ = model.value
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[places] = values
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            scores = [np.zeros(0)]
            for start, stop in chunks(offsets):
                part = offsets[start : stop + 1]
                scores.append(score_chunk(data[part[0] : part[-1]], part - part[0], table, bias_))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], schema.names)

    return docs.mapInArrow(run, schema)
