import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared lines and passages, among random texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    passage, shared = sentence(70), [sentence(8) for _ in range(3)]
    texts = []
    for k in range(60):
        parts = [sentence(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        if k % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), passage)
        if k % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), "  " + shared[k % 2].upper() + "\t")
        texts.append("\n".join(parts))
    base = texts[1] + " " + sentence(120)
    for _ in range(25):
        words = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [base, base, texts[2], None, "", " ", "\n\n", "one", "one two", "ONE", None]
    return [(k, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and clashing extra columns."""
    long = " ".join(f"word{k % 997}" for k in range(60_000)) + "\n" + "x" * 200_000
    rows = [
        (1, "plain text of some words that is a little longer than ten words in all", "en", "a", 70),
        (1, "plain text of some words that is a little longer than ten words in all", "en", "a", 70),
        (1, "another text under the same id", None, "a", None),
        (None, "text without an id", "en", None, 18), (None, "text without an id", "en", None, 18), (None, None, None, None, None),
        (2, None, "en", "b", 0), (3, "", "en", "b", 0), (4, "\n \t\n", None, "b", 4), (5, long, "en", "b", len(long)), (6, long, "en", None, len(long)),
        (7, "tie", "x", "c", 3), (8, "tie", "x", "c", 3),
    ]
    extra = [r + (k, "h", 0.5, k, "z", k, None, 1) for k, r in enumerate(rows)]
    clash = ", h long, pos string, score double, block long, place string, epoch int, k2 string, n_words int"
    return spark.createDataFrame(extra, DOCUMENTS + clash)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
