"""The disclosure statistic of op5 against plain counting; copies of a text are no evidence."""

import math
import random
from collections import defaultdict

import pytest

from casario.llm import privacy
from tests.llm import brute


def revealed_words(texts) -> dict[str, str]:
    """Word to action, by counting words, values and classes over distinct texts."""
    texts = sorted({t or "" for t in texts})
    of_value, of_word, both = defaultdict(int), defaultdict(int), defaultdict(int)
    for text in texts:
        spans = privacy.base_spans(text)
        free = text
        for _, a, b in spans:
            free = free[:a] + "\n" * (b - a) + free[b:]
        # a word that touches a value is left out
        words = set()
        for m in brute.ALNUM.finditer(free.translate(brute.UPPER)):
            if not any(a < m.end() and m.start() < b for _, a, b in spans) and not any(m.end() == a or m.start() == b for _, a, b in spans):
                words.add(m.group())
        values = set()
        for kind, a, b in spans:
            raw = text[a:b].lower() if kind in ("email", "ip") else "".join(c for c in text[a:b] if c.isdigit())
            values.add((kind, raw))
            values.add((kind + " class", {"email": raw.split("@")[-1], "ip": raw.rpartition(".")[0]}.get(kind, raw[:6])))
        for w in words:
            of_word[w] += 1
        for v in values:
            of_value[v] += 1
            for w in words:
                both[v, w] += 1
    out = {}
    for (v, w), n in both.items():
        share = n / of_word[w]
        if n >= 3 and of_value[v] >= 3 and share >= 0.5 and math.log2(share * len(texts) / of_value[v]) >= 4:
            out[w] = "remove" if share >= 0.9 else out.get(w, "generalise")
    return out


def filler(rng, n):
    vocabulary = [f"w{k}" for k in range(150)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    texts = [filler(rng, 30) for _ in range(300)]
    # one firm, several addresses: only the domain recurs
    texts += [f"Acmecorp {filler(rng, 9)} person{k}@acme.example {filler(rng, 3)}" for k in range(6)]
    texts += [f"Brandt {filler(rng, 8)} +49 30 1234{k}0 " for k in range(5)] + [f"Brandt again {filler(rng, 6)}" for _ in range(3)]
    texts += [f"Hostname {filler(rng, 5)} 10.20.30.{k}" for k in range(4)]
    texts += [f"Solo speaks {filler(rng, 12)} solo@one.example"] * 40 + [None, "", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block_rows", [privacy.BLOCK_ROWS, 2])
def test_marks_equal_plain_counting(spark, rows, block_rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = revealed_words([t for _, t in rows])
    assert {"acmecorp", "hostname"} <= set(want) and "solo" not in want and "speaks" not in want
    for r, (_, text) in zip(sorted(privacy.private_spans(docs, block_rows).collect(), key=lambda r: r.doc_id), rows):
        text, base = text or "", privacy.base_spans(text or "")
        marked = {(s.kind, text[s.start : s.end].translate(brute.UPPER)) for s in r.term_spans}
        words = {m.group() for m in brute.ALNUM.finditer(text.translate(brute.UPPER)) if all(m.end() < a or m.start() > b for _, a, b in base)}
        assert marked == {(want[w], w) for w in words if w in want}


@pytest.mark.parametrize("copies", [3, 1000])
def test_copies_keep_their_words(spark, copies):
    rng = random.Random(1)
    sentence = "Please write to our friend Quentin under quentin@home.example before the spring meeting"
    rows = [(k, filler(rng, 20)) for k in range(200)] + [(1000 + k, sentence) for k in range(copies)]
    clean = privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("doc_id >= 1000").collect()
    assert {r.text for r in clean} == {sentence.replace("quentin@home.example", "<email>")} and len(clean) == copies
