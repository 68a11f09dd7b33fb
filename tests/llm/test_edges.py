"""Nulls, empty and very long texts, repeated rows, ties, clashing columns and empty tables, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casario.llm import chat, decontaminate, lines, mixing, neardup, privacy, rules, substrings, toxicity, urls
from tests.llm import brute

LABELS = "doc_id long, quality int, toxic int"


def row_key(r):
    return repr(r.doc_id), repr(r.text)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 0, 1), (None, 1, 1), (7, None, None), (8, 3, 2)], LABELS)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "some words that is a little longer than ten words"), (1, "some words that is a little longer than ten words"), (None, None), (2, ""), (None, "tie")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_rows_in_rows_out(spark, awkward, labels, benchmark):
    rows = sorted(map(row_key, awkward.collect()))
    same = [
        toxicity.score(awkward, *toxicity.learn(awkward, labels.withColumnRenamed("toxic", "label"))),
        rules.quality(awkward, labels).select(f"{rules.ROW}.*"),
        substrings.remove_repeats(awkward, 40), lines.drop_shared_lines(awkward, min_docs=99), decontaminate.matches(awkward, benchmark),
    ]
    for out in same:
        assert sorted(map(row_key, out.collect())) == rows
        assert out.columns[: len(awkward.columns)] == awkward.columns
    assert privacy.sanitise(awkward).columns == awkward.columns and privacy.sanitise(awkward).count() == len(rows)


def test_statistics_and_verdicts(awkward, labels):
    for r in rules.quality(awkward, labels).collect():
        assert tuple(r[c] for c in rules.BASE) == brute.statistics(r[rules.ROW].text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept is not None


def test_repeats_count_repeated_rows(awkward):
    texts = [r.text for r in awkward.collect()]
    want = {(t or ""): w for t, w in zip(texts, brute.substrings(texts, 40)) if len(t or "") < 10_000}
    for r in substrings.remove_repeats(awkward, 40).collect():
        n = len((r.text or "").encode())
        if n < 10_000:
            assert (n, n - len(r["__llm_kept"]), len(r["__llm_spans"])) == want[r.text or ""][:3]
        else:
            assert n > 0 and len(r["__llm_kept"]) == 0  # the long text is there twice


def test_lines_of_repeated_rows(awkward):
    rows = awkward.collect()
    out = lines.drop_shared_lines(awkward, min_docs=2).collect()
    docs = [(repr(r.doc_id), r.text) for r in rows]
    assert sorted((r.text or "", r["__llm_lines"], r["__llm_dropped"]) for r in out) == sorted(brute.lines(docs, 2))
    assert sum(r["__llm_dropped"] for r in out) > 0


def test_near_duplicates_of_repeated_rows(awkward):
    found = neardup.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    by_size = sorted(r.links for r in found)
    # two rows each of four texts; "tie" and the long text under two ids
    assert by_size == [0] * 5 + [1] * 8
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns
    texts = [r.text for r in kept.collect()]
    assert len([t for t in texts if t and t.split()]) == 5 and len(texts) == 5 + 4


def test_contamination_of_repeated_items(awkward, benchmark):
    found = {row_key(r): r["__llm_found"] for r in decontaminate.matches(awkward, benchmark).collect()}
    hits = {k[1]: v["items"] for k, v in found.items() if v.spans}
    assert sorted(hits.values()) == [[""], ["1"]]


def test_mixture(awkward):
    mixed = mixing.mix(awkward)
    assert len(set(mixed.columns)) == len(mixed.columns)
    assert mixed.where(F.col("n_tokens") > 0).count() > 0


def test_chats_and_captures(spark):
    turns = spark.createDataFrame(
        [(None, 1, "user", None), (1, None, None, "x" * 300_000), (1, None, None, "x" * 300_000), (1, 2, "assistant", ""), (2, 1, "user", "a"), (2, 1, "user", "a")],
        "conv_id long, turn long, role string, text string",
    ).withColumn("formatted", F.lit(1))
    got = {r.conv_id: r.n_turns for r in chat.chat_digests(chat.format_chats(turns)).collect()}
    assert got == {None: 1, 1: 3, 2: 2}
    captures = spark.createDataFrame([(None, None, None), (1, "http://a.b/" + "c/" * 500, None)], "page_id long, url string, at string").withColumn("at", F.to_timestamp("at"))
    log = spark.createDataFrame([], "pattern string, action string, at timestamp")
    assert urls.blocked_captures(captures.withColumn("pattern", F.lit(1)), log, at="at").count() == 2


def test_empty_tables(spark, nothing, labels, benchmark):
    none = labels.limit(0)
    outs = [
        toxicity.score(nothing, *toxicity.learn(nothing, none.withColumnRenamed("toxic", "label"))), rules.quality(nothing, none),
        substrings.remove_repeats(nothing), lines.drop_shared_lines(nothing), privacy.private_spans(nothing), privacy.sanitise(nothing), mixing.mix(nothing),
        decontaminate.matches(nothing, benchmark.limit(0)), neardup.near_duplicates(nothing), neardup.keep_one(nothing),
        chat.chat_digests(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        urls.blocked_captures(spark.createDataFrame([], "page_id long, url string, fetched_at timestamp"), spark.createDataFrame([], "pattern string, action string, at timestamp")),
    ]
    for out in outs:
        assert out.count() == 0


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, labels, benchmark):
    path = tmp_path_factory.mktemp("tables")
    labels.write.parquet(f"{path}/labels.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, awkward, nothing, sf_dir, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "benchmark_decontamination", "source_mix"]
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward, nothing):
            out = stage(spark, docs, sf_dir)
            if name != "source_mix":
                assert out.columns == docs.columns
                assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            rows = out.collect()
            assert rows or docs is nothing
