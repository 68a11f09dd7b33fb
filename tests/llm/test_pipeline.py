"""The pipeline against a plain composition of the plain operators."""

import corpus_pipeline
from casario.llm import rules
from tests.llm import brute

ROWS_IN = "doc_id long, text string, lang string, source string, n_chars long"


def holds(rule, values):
    return all((values[c.name] > c.cut) if c.above else (values[c.name] <= c.cut) for c in rule)


def test_pipeline(spark, corpus, tmp_path):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in corpus]
    junk = [(1000 + k, " ".join(f"w{k}x{j}%%%" for j in range(40)), "en", "s0", 0) for k in range(60)]
    docs = rows + junk
    labels = [(k, 1, 0) for k, *_ in rows] + [(k, 0, 0) for k, *_ in junk]
    item = " ".join(brute.words(corpus[5][1])[2:20])
    spark.createDataFrame(docs, ROWS_IN).write.parquet(f"{tmp_path}/documents.parquet")
    label_frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    label_frame.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # the plain version applies the learned list, which tests of the operator cover
    learned = rules.learn_from(spark.createDataFrame(docs, ROWS_IN), label_frame)
    assert learned
    left = []
    for d in docs:
        n, chars, symbols, dup, repeat = brute.statistics(d[1])
        values = {"symbol_share": symbols / chars if chars else 0.0, "n_words": n, "repeat_share": repeat / n if n else 0.0, "word_length": chars / n if n else 0.0}
        known = all(c.name in values for rule in learned for c in rule)
        assert known, [str(c) for rule in learned for c in rule]
        if n >= 10 and 100 * repeat <= 20 * n and not any(holds(rule, values) for rule in learned):
            left.append((d[0], d[1]))
    assert len(left) < len(docs) - 50
    left = [(k, text) for (k, _), (text, _, _) in zip(left, brute.lines(left, 10))]
    classes = brute.near_duplicates(left)
    left = [d for d, (first, _) in zip(left, classes) if first == d[0] or not brute.words(d[1])]
    clean = brute.contamination([t for _, t in left], [(1, item)], 10)
    left = [d for d, (_, hit, _) in zip(left, clean) if not hit]

    want = dict(left)
    assert {r.doc_id for r in out} <= set(want)
    assert all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in out)
    # the budget is that of all tokens, so no source loses everything
    assert len({r.doc_id for r in out}) > 0.5 * len(want)
