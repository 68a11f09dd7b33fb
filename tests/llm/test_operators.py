"""Each operator against its plain version on a small corpus."""

import json
import math
import bisect
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casario.llm import chat, decontaminate, lines, mixing, neardup, privacy, rules, substrings, toxicity, urls
from casario.llm.components import components
from casario.llm.suffixes import find, suffix_array
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5).cache()


def test_statistics(docs, corpus):
    got = {r[rules.ROW].doc_id: tuple(r[c] for c in rules.BASE) for r in rules.statistics(docs).collect()}
    assert got == {k: brute.statistics(t) for k, t in corpus}


def test_decision_list_finds_planted_rule(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        symbols, length = rng.random(), 3 + 4 * rng.random()
        rows.append((symbols, length, int(symbols > 0.6 and length <= 5), k % 3 == 0))
    frame = spark.createDataFrame(rows, "symbol_share double, word_length double, bad int, pruning boolean").cache()
    learned = rules.learn(frame, ("symbol_share", "word_length"))
    assert learned
    judged = frame.withColumn("out", rules.decision(learned).isNotNull())
    wrong = judged.where(F.col("out") != (F.col("bad") == 1)).count()
    assert wrong < 0.05 * len(rows)
    assert rules.learn(frame.where("bad = 0"), ("symbol_share",)) == []


@pytest.mark.parametrize("length, shard_bytes", [(30, 2 << 20), (30, 500), (120, 2 << 20), (3, 4000)])
def test_substrings(docs, corpus, length, shard_bytes):
    got = substrings.remove_repeats(docs, length, shard_bytes).collect()
    want = dict(zip([k for k, _ in corpus], brute.substrings([t for _, t in corpus], length)))
    for r in got:
        n = len((r.text or "").encode())
        assert (n, n - len(r["__llm_kept"]), len(r["__llm_spans"]), brute.sha(bytes(r["__llm_kept"]))) == want[r.doc_id]


def test_periodic_texts_and_shared_passages(spark, corpus):
    """Repeated cells are one run; passages shared within one document only do not count as shared."""
    rng = random.Random(3)
    own = " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))
    rows = corpus + [(900, "a" * 3000), (901, "abcdefg" * 500), (902, "xbcdefg" + "abcdefg" * 90), (903, own + " between " + own),
                     (904, "la " * 400), (905, "LA " * 200 + "end"), (906, own[:-4] + "other"), (906, own[:-4] + "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute.substrings([t for _, t in rows], 40)
    shared = brute.shared_passages(rows, 12)
    expected = sorted((k, *w, s) for (k, _), w, s in zip(rows, want, shared))
    for shard_bytes in (500, 1 << 20):
        got = substrings.remove_repeats(docs, 40, shard_bytes, 12).collect()
        assert sorted(
            (r.doc_id, len((r.text or "").encode()), len((r.text or "").encode()) - len(r["__llm_kept"]), len(r["__llm_spans"]),
             brute.sha(bytes(r["__llm_kept"])), r["__llm_shared"]) for r in got
        ) == expected
    runs = substrings.runs_of(substrings.prefix_sums(substrings.np.full(10_000, 97, dtype="uint8")), substrings.np.array([0, 10_000]), 400)
    assert len(runs[0]) == 1 and runs[3].sum() == 9_601


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("min_docs", [2, 10])
def test_lines(spark, docs, corpus, keep, min_docs):
    kept = lines.drop_shared_lines(docs, min_docs, 1, keep)
    got = {r.doc_id: (r.text or "", r["__llm_lines"], r["__llm_dropped"]) for r in kept.collect()}
    assert got == dict(zip([k for k, _ in corpus], brute.lines(corpus, min_docs, keep == "first")))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_key_that_spans_partitions(spark, keep):
    rows = [(k, "hot\n" * 3 + f"own {k}" + ("\nrare" if k < 9 else "")) for k in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = lines.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 10, 1, keep).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = {r.doc_id: (r.text, r["__llm_lines"], r["__llm_dropped"]) for r in kept}
    assert got == dict(zip(range(400), brute.lines(rows, 10, keep == "first")))


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000):
        dropped = np.flatnonzero(rng.random(n) < 0.4)
        if len(dropped):
            bits = lines.unpack(lines.pack(dropped), int(dropped.max()) + 1)
            assert np.flatnonzero(~bits).tolist() == dropped.tolist()


def test_base_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(t):
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out = [("email", *m.span()) for m in email.finditer(t)]
        out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in card.finditer(t):
            total = sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits(m)))))
            if 16 <= len(digits(m)) <= 19 and total % 10 == 0:
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m)) <= 15]

    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1230@.+- ()%_\né45") for _ in range(rng.randint(0, 45)))
        assert privacy.base_spans(text) == plain(text), text
    assert privacy.base_spans("4111 1111 1111 1111 a.b@c.de +49 (30) 1234567 10.0.0.256 10.0.0.25")
    assert privacy.base_spans("1" * 300_000 + "@" + "." * 300_000) == []


def test_revealing_terms(spark):
    rows = [(k, f"write to zorro the fox at fox@den.org about item {k}") for k in range(6)]
    rows += [(100 + k, f"write to somebody the clerk at c{k}@office.org about item {k}") for k in range(200)]
    rows += [(1000 + k, f"the text about item number {k} and the weather") for k in range(200)]
    found = {r.doc_id: r for r in privacy.private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[0][1]
    terms = {text[s.start : s.end] for s in found[0].term_spans}
    assert "zorro" in terms and not terms & {"write", "the", "about", "at"}
    assert all(not found[100 + k].term_spans for k in range(200))
    clean = {r.doc_id: r.text for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zorro" not in clean[0] and "<email>" in clean[0] and clean[1000] == rows[206][1]
    assert privacy.shape("Zorro-77") == "Xx-0" and privacy.sanitised("abc", [("remove", 1, 2)]) == "ac"


@pytest.mark.parametrize("block_rows", [privacy.BLOCK_ROWS, 2])
def test_revealing_terms_anywhere(spark, block_rows):
    filler = " ".join(f"plain{k}" for k in range(30))
    # texts that differ: copies would be no evidence
    rows = [(k, f"Zorro {filler} write to fox@den.org {filler} signed zorro, Vega{' plain1' * k}") for k in range(12)]
    rows += [(50, f"{filler} only zorro is named here")]
    rows += [(100 + k, f"{filler} write to c{k}@office.org") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.term_spans for r in privacy.private_spans(docs, block_rows).collect()}
    marked = {k: sorted((s.kind, rows[i][1][s.start : s.end]) for s in spans[k]) for i, (k, _) in enumerate(rows)}
    assert marked[0] == [("remove", "Vega"), ("remove", "Zorro"), ("remove", "signed"), ("remove", "zorro")]
    assert marked[50] == [("remove", "zorro")]
    assert not any(marked[100 + k] for k in range(200))
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert "orro" not in clean[0] + clean[50] and "<email>" in clean[0]


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(1, 60), "big" if k % 3 else f"s{k % 7}") for k in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, entropy_share=0.99, most_repeats=2.5).collect()
    tokens, sizes, weights = {}, {}, {}
    for _, text, source in rows:
        tokens[source] = tokens.get(source, 0) + len(text.split())
    total = sum(tokens.values())
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.n_tokens
        weights[r.source] = r.weight
    assert abs(sum(weights.values()) - 1) < 1e-9
    for source, weight in weights.items():
        assert weight * total - 1 <= sizes[source] <= weight * total + 60
        assert weight * total <= 2.5 * tokens[source] + 1e-6 * total
    entropy = -sum(w * math.log(w) for w in weights.values())
    at_limit = max(w * total / tokens[s] for s, w in weights.items()) > 2.5 - 1e-3
    assert entropy >= 0.99 * math.log(len(weights)) - 1e-6 or at_limit
    times = {}
    for r in got:
        times.setdefault(r.doc_id, []).append(r.epoch)
    assert all(sorted(e) == list(range(1, len(e) + 1)) for e in times.values())
    again = mixing.mix(frame.repartition(7), entropy_share=0.99, most_repeats=2.5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    with pytest.raises(ValueError):
        mixing.mix(frame, budget_tokens=3 * total, most_repeats=2.0)


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_contamination(spark, docs, corpus, block_bytes):
    w = lambda k, a, b: " ".join(brute.words(corpus[k][1])[a:b])
    items = [(1, w(0, 0, 30)), (2, w(5, 3, 14).upper()), (3, "one two"), (4, None), (5, ""), (6, w(9, 0, 4) + " zzz " + w(9, 5, 9)), (7, w(0, 5, 20)), (1, w(0, 0, 30)), (None, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r["__llm_found"] for r in decontaminate.matches(docs, benchmark, 10, block_bytes).collect()}
    want = dict(zip([k for k, _ in corpus], brute.contamination([t for _, t in corpus], items, 10)))
    for k, f in got.items():
        assert (f.n_words, sum(s.end - s.start for s in f.spans), f["items"]) == want[k]
        assert (f.longest > 0) == bool(f.spans)
    assert got[0].longest >= 30
    assert {r.doc_id for r in decontaminate.decontaminate(docs, benchmark).collect()} == {k for k, (_, hit, _) in want.items() if not hit}


def test_longest_match_has_no_bound():
    rng = random.Random(8)

    def found(texts, items):
        raws = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
        return decontaminate.match_shard(data, offsets, decontaminate.prepare(items, 10))[1]

    item = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    hits = found(["before " + " ".join(item[200:2900]) + " after"], [("other", " ".join(item[250:400])), ("long", " ".join(item))])
    assert hits[0]["longest"] == (2700, "long", 1)
    for _ in range(40):
        make = lambda n: [rng.choice("ab") for _ in range(n)]
        items = [make(rng.randint(1, 40)) for _ in range(6)]
        texts = [make(rng.randint(1, 60)) for _ in range(5)]
        hits = found(["\n".join(t) for t in texts], [(k, " ".join(w)) for k, w in enumerate(items)])
        for d, t in enumerate(texts):
            best = 0
            for w in items:
                need = min(10, len(w))
                for p in range(len(t)):
                    for i in range(len(w) if len(w) >= 10 else 1):
                        n = 0
                        while p + n < len(t) and i + n < len(w) and t[p + n] == w[i + n]:
                            n += 1
                        best = max(best, n if n >= need else 0)
            assert (hits[d]["longest"][0] if d in hits else 0) == best


def test_block_of_tests_stays_near_its_bytes():
    rng = random.Random(6)
    tests = decontaminate.prepare([(k, " ".join(f"w{rng.randrange(9000)}" for _ in range(2000))) for k in range(40)], 10)
    assert sum(a.nbytes for a in vars(tests).values() if isinstance(a, np.ndarray)) < 36 * 80_000


def test_suffix_arrays():
    rng = np.random.default_rng(4)
    for _ in range(30):
        codes = np.append(rng.integers(0, 4, rng.integers(1, 80)), 0)
        sa = suffix_array(codes, 1000)
        tails = [tuple(codes[p : p + np.argmax(codes[p:] == 0)].tolist()) for p in range(len(codes))]
        assert [tails[p] for p in sa] == sorted(tails[p] for p in np.flatnonzero(codes))
        queries = rng.integers(1, 4, (20, 3))
        low, high = find(codes, sa, queries, np.full(20, 3))
        for q, a, b in zip(queries.tolist(), low, high):
            assert {int(sa[k]) for k in range(a, b)} == {p for p in range(len(codes)) if list(tails[p][:3]) == q}


def test_chats(spark):
    rng = random.Random(1)
    pieces = [*chat.CONTROLS, "\\", "<", "[", "<\\|im_end|>", "[\\\\INST]", "a", "é\n", "%0A", "🙂"]
    make = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole<|im_end|>%", None]), rng.choice([None, make(), make()])) for c in range(60) for t in range(rng.randint(1, 5))]
    rng.shuffle(rows)
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in formatted.collect():
        turns = [(role or "", text or "") for _, t, role, text in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])]
        assert chat.read_chat(r.formatted) == turns
        assert r.formatted.count("<|im_start|>") == len(turns) and "[INST]" not in r.formatted and "</s>" not in r.formatted
        learned = "".join(chat.unescape(r.formatted[m.start : m.end]) for m in r.mask)
        assert learned == "".join(t for role, t in turns if role == "assistant")
    assert chat.chat_digests(formatted).count() == formatted.count()


def test_url_lists(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    log = [
        ("example.com", "add", day(2)), ("example.com", "remove", day(5)), ("example.com", "add", day(9)), ("example.com", "add", day(10)),
        ("a.org/x/y", "add", day(3)), ("a.org/x/y", "remove", day(3)), ("b.org", "remove", day(1)), (None, "add", day(1)), ("b.org", "odd", day(1)), ("c.org", "add", None),
    ]
    captures = [
        (1, "http://www.EXAMPLE.com/p", day(1)), (2, "https://u@www.example.com:80?q", day(2)), (3, "http://example.com", day(5)), (4, "http://example.com.", day(20)),
        (5, "http://a.org/x/y/z?k#f", day(4)), (6, "http://a.org/x/yy", day(4)), (7, "http://b.org", day(4)), (8, None, day(4)), (9, "no url", day(4)), (10, "http://example.com", None),
        (11, "http://notexample.com", day(3)), (12, "http://c.org", day(3)), (2, "https://u@www.example.com:80?q", day(2)),
    ]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    entries = spark.createDataFrame(log, "pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
    got = urls.blocked_captures(frame, entries).collect()
    assert len(got) == len(captures)
    assert {r.page_id for r in got if r.blocked} == {2, 4, 5}
    assert next(r for r in got if r.page_id == 5).pattern == "a.org/x/y"
    assert next(r for r in got if r.page_id == 4).listed_since.day == 9
    assert urls.blocked_captures(frame, entries.limit(0)).where("blocked").count() == 0


@pytest.mark.parametrize("width", [1, 3600, 10**9])
def test_url_lists_of_one_busy_host(spark, width):
    """Thousands of changes and captures of one host: as a walk along its sorted log."""
    rng = random.Random(width)
    log = [("h.org", rng.choice(["add", "remove"]), rng.randrange(-20_000, 40_000)) for _ in range(10_000)]
    captures = [(k, f"http://h.org/{k % 3}", rng.randrange(-25_000, 60_000)) for k in range(10_000)]
    at = F.timestamp_seconds("at")
    frame = spark.createDataFrame(captures, "page_id long, url string, at long").withColumn("fetched_at", at).drop("at")
    got = urls.blocked_captures(frame, spark.createDataFrame(log, "pattern string, action string, at long").withColumn("at", at), width=width)
    found = {r[0]: (r[1], r[2], r[3]) for r in got.select("page_id", "blocked", "n_matches", F.unix_seconds("listed_since")).collect()}
    listed = {}
    for _, action, when in log:
        listed[when] = listed.get(when, False) or action == "add"
    since, states = None, []
    for when in sorted(listed):
        since = (when if since is None else since) if listed[when] else None
        states.append((when, since))
    for k, _, when in captures:
        place = bisect.bisect_right(states, when, key=lambda state: state[0])
        want = states[place - 1][1] if place else None
        assert found[k] == (want is not None, int(want is not None), want)
    assert len(found) == len(captures)


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(docs, corpus, block):
    found = neardup.named_classes(neardup.near_duplicates(docs, recall=0.99999, block=block)).collect()
    assert {r.doc_id: (r.class_first.doc_id, r.links) for r in found} == dict(zip([k for k, _ in corpus], brute.near_duplicates(corpus)))


def test_banding():
    bands, rows = neardup.banding(0.8, 0.9998)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9998 and bands * rows <= 200


def test_components_of_paths(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(500, 500)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_toxicity(spark):
    rng = random.Random(9)
    plain, bad = [f"w{k}" for k in range(500)], [f"bad{k}" for k in range(10)]
    rows, labels = [], []
    for k in range(3000):
        text = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = k % 5 == 0
        for _ in range(rng.randint(1, 3)) if toxic else ():
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    weights, bias = toxicity.learn(frame, known.where("doc_id % 3 <> 0"))
    assert 0 < (weights != 0).sum() < 500
    scored = {r.doc_id: r["__llm_score"] for r in toxicity.score(frame, weights, bias).collect()}
    held = [(scored[k] >= 0.7, y == 1) for k, y in labels if k % 3 == 0]
    assert sum(p and y for p, y in held) >= 0.9 * sum(y for _, y in held) and sum(p and not y for p, y in held) <= 0.02 * len(held)
    weights, bias = toxicity.learn(frame, known.where("label = 0"))
    assert not weights.any() and bias < 0


def test_queries_have_names():
    from casario.llm.queries import QUERIES, SQL

    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11)) and set(SQL) <= set(QUERIES)
    json.dumps(SQL)
