"""Sharding, phrase collocations and fill-in-the-middle against plain versions, and their odd inputs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casario.llm import infill, phrases, queries, sharding
from tests.llm import brute


@pytest.fixture(scope="module")
def spoken():
    """(lang, text) rows of few words, so that long phrases repeat."""
    rng = random.Random(11)
    vocabulary = ["a", "ab", "the", "no", "ça", "x-1", "(b)", "THE", "Zu", "été"]
    fixed = "in spite of all that"
    rows = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if k % 3 == 0:
            words.insert(rng.randint(0, len(words)), fixed)
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", ", ", ".\n", "!"]) for w in words)
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows + [("en", None), ("fr", ""), ("xx", " \t."), (None, "alone")] + [("en", "same text of copies, same text of copies")] * 30


@pytest.mark.parametrize("least, most, top, rows", [(5, 5, 2000, 1 << 20), (5, 5, 2000, 0), (2, 3, 7, 1 << 20), (8, 2, 50, 0), (10**6, 5, 10, 0)])
def test_collocations(spark, spoken, least, most, top, rows):
    docs = spark.createDataFrame(spoken, "lang string, text string").repartition(4)
    found = phrases.collocations(docs, least, most, top, broadcast_rows=rows).collect()
    assert sorted(map(tuple, found)) == sorted(brute.collocations(spoken, least, most, top))


@pytest.mark.parametrize("size", [1, 200])
def test_chunks_of_any_size_count_alike(spark, spoken, size):
    docs = spark.createDataFrame(spoken, "lang string, text string").repartition(3)
    found = phrases.collocations(docs, 5, 4, 100, chunk_bytes=size).collect()
    assert sorted(map(tuple, found)) == sorted(brute.collocations(spoken, 5, 4, 100))


def test_dense_tiles_count_as_sparse_ones():
    rng = np.random.default_rng(5)
    a = np.concatenate((rng.integers(0, 300, 90_000), rng.integers(0, 1 << 30, 5_000), np.full(40_000, 1025)))
    b = np.concatenate((rng.integers(0, 300, 90_000), rng.integers(0, 5_000, 5_000), rng.integers(1024, 1100, 40_000)))
    codes = (a.astype(np.int64) << 32) | b
    found, n = phrases.count_codes(codes)
    want = Counter(codes.tolist())
    assert len(found) == len(want) and dict(zip(found.tolist(), n.tolist())) == want
    assert [len(x) for x in phrases.count_codes(codes[:0])] == [0, 0]


def test_scores_beyond_64_bits(spark):
    # 1000 * a * n passes 2^63 long before its parts do
    big = spark.createDataFrame([("en", "p q", 4 * 10**9, 3 * 10**12, [5 * 10**9], [6 * 10**9])], "lang string, phrase string, f long, n long, prefixes array<long>, suffixes array<long>")
    row = phrases.scored(big).first()
    assert row["score"] == 1000 * 4 * 10**9 * 3 * 10**12 // (5 * 10**9 * 6 * 10**9)


def test_phrases_of_odd_rows(spark, awkward, nothing):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    found = phrases.collocations(awkward, 2, 3, 50).collect()
    assert sorted(map(tuple, found)) == sorted(brute.collocations(rows, 2, 3, 50))
    assert phrases.collocations(nothing, 2).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(nothing, 2, most_words=1)


def test_infill(spark, corpus, awkward):
    odd = [(900, "<S> stays"), (901, "a<P>"), (902, "ends in <"), (903, "é" * 50 + "<"), (904, "<" * 9), (905, "a"), (906, "漢字 kanji🙂🙂 ok"), (907, "x" * 70)]
    rows = corpus + odd + [(r.doc_id, r.text) for r in awkward.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    form, output = F.col("__llm_form"), F.col("__llm_output")
    cut = infill.fill_in_middle(docs).withColumn("back", infill.restored(output, form))
    got = sorted(repr((r.doc_id, r.text, r["__llm_tokens"], r["__llm_form"], r["__llm_prefix"], r["__llm_middle"], r["__llm_output"], r.back)) for r in cut.collect())
    assert got == sorted(repr((k, t, *brute.infilled(k, t), t or "")) for k, t in rows)
    assert {r["__llm_form"] for r in cut.select(form).collect()} == {"plain", "psm", "spm"}


def test_infill_shares_and_columns(awkward, nothing):
    all_spm = infill.fill_in_middle(awkward, plain_percent=0, spm_percent=100)
    assert all_spm.columns[: len(awkward.columns)] == awkward.columns
    assert {r["__llm_form"] for r in all_spm.where("text <> ''").collect()} == {"spm"}
    assert infill.fill_in_middle(nothing).count() == 0


def test_token_ends_match_a_plain_scan():
    rng = np.random.default_rng(2)
    for _ in range(200):
        texts = ["".join(rng.choice(list("abZ@[`{é漢🙂 \n"), rng.integers(0, 25))) for _ in range(rng.integers(1, 6))]
        raw = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        tokens, points = infill.marks(np.frombuffer(b"".join(raw), np.uint8), offsets)
        ends, at = [], 0
        for t in texts:
            for token in brute.re.findall(r"[A-Za-z]+|[^A-Za-z]", t):
                at += len(token.encode())
                ends.append(at)
        assert tokens.end(np.arange(1, len(ends) + 1)).tolist() == ends
        assert np.diff(points.rank(offsets)).tolist() == [len(t) for t in texts]


def shard_rows(docs, shards, units=sharding.UNITS):
    planned = sharding.plan(docs, shards, units)
    return sharding.with_slot(sharding.with_shard(docs, planned)).collect(), planned


def test_shards(spark, corpus, awkward):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    rows, planned = shard_rows(docs, 4)
    assert sorted(repr((r.doc_id, r.text)) for r in rows) == sorted(map(repr, corpus))
    groups = Counter()
    for _, t in corpus:
        groups[t or ""] += len((t or "").encode()) + 1
    assert sorted(planned.loads) == sorted(brute.longest_first(list(groups.values()), 4))
    check_shards(rows, planned)
    rows, planned = shard_rows(awkward, 3)
    assert len(rows) == awkward.count()
    check_shards(rows, planned)


def check_shards(rows, planned):
    loads, slots, home = Counter(), {}, {}
    for r in rows:
        assert r[sharding.SIZE] == len((r.text or "").encode()) + 1
        loads[r[sharding.SHARD]] += r[sharding.SIZE]
        slots.setdefault(r[sharding.SHARD], []).append(r[sharding.SLOT])
        assert home.setdefault(r.text or "", r[sharding.SHARD]) == r[sharding.SHARD]
    assert [loads[k] for k in range(len(planned.loads))] == planned.loads
    for taken in slots.values():
        assert sorted(taken) == list(range(len(taken)))


def test_small_groups_share_bundles(spark):
    rows = [(k, f"text {k} " + "y" * (k % 97)) for k in range(5_000)] + [(k, "hot " * 20) for k in range(2_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    placed, planned = shard_rows(docs, 4, units=1)  # 256 bundles for 5,000 groups
    assert planned.units == 256 and planned.bundles.count() <= 256 and planned.groups.count() < 256
    check_shards(placed, planned)
    # the hot group fills a shard by itself; the others are even
    largest = max(planned.loads)
    others = sorted(planned.loads)[:3]
    assert largest == 2_500 * 81 and others[2] - others[0] < 0.01 * sum(others)


def test_shards_of_nothing_and_of_own_groups(spark, nothing, awkward, tmp_path):
    assert sharding.with_slot(sharding.with_shard(nothing, sharding.plan(nothing, 3))).count() == 0
    by_source = F.col("source")
    loads = sharding.write_shards(awkward, f"{tmp_path}/out", 2, group=by_source)
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.count() == awkward.count() and set(written.columns) == {*awkward.columns, "shard"}
    assert written.groupBy("source").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sum(loads) == sum(len((r.text or "").encode()) + 1 for r in awkward.collect())
    with pytest.raises(ValueError):
        sharding.plan(nothing, 0)


def test_shard_query_contract(spark, tmp_path):
    rows = [(k, "copy" if k % 3 == 0 else f"text {k}é" * (k % 40)) for k in range(900)] + [(901, None), (902, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(rows)
    found = queries.op11_sharding(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        assert (r.text_crc32, r.law, r.grown_shard) == (zlib.crc32((texts[r.doc_id] or "").encode()), "bytes", None)
        assert 0 <= r.shard < 16


def test_rows_of_a_chunk_stay_short(spark, monkeypatch):
    """Thousands of rows of occurrences are held at a time, so a chunk is not one row; rows put together make no new pairs."""
    rng = np.random.default_rng(3)
    for ids in (rng.integers(-1, 4, 50_000), np.arange(3_000), np.zeros(0), np.full(9, -1)):
        ids = ids.astype(np.int32)
        rows = phrases.cut_rows(ids)
        back = np.concatenate([phrases.joined_rows(rows.slice(k, 1)) for k in rng.permutation(len(rows))])
        assert Counter(phrases.neighbours(back)[1].tolist()) == Counter(phrases.neighbours(ids)[1].tolist())
    assert max(len(phrases.joined_rows(phrases.cut_rows(rng.integers(-1, 4, 50_000).astype(np.int32)).slice(k, 1))) for k in range(50)) < 2 * phrases.ROW_IDS
    sizes, written = [], phrases._written

    def watched(df, label):
        out = written(df, label)
        sizes.append(out.agg(F.max(F.length("ids"))).first()[0])
        return out

    monkeypatch.setattr(phrases, "_written", watched)
    docs = spark.createDataFrame([("en", "one two, three four five. " * 4_000)], "lang string, text string")
    rows = [(r.phrase, r.a) for r in phrases.collocations(docs).collect()]
    assert sorted(rows) == [("one two", 4_000), ("three four five", 4_000)]
    assert sizes and max(sizes) < 8 * phrases.ROW_IDS
