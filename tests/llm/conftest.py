"""Small corpora: an ordinary one with copies and near copies, an awkward one, and an empty one."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out int, tie string, blk string, label string, kept int, tie0 string"


def make(spark, pairs):
    rows = [(i, t, random.Random(k).choice(["en", "de", None]), None, None, 0.1, 7, "x", "y", "z", 3, "w") for k, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    words = ["the", "of", "and", "in", "to"] + ["".join(rng.choices(["th", "er", "on", "an", "re", "é", "ing"], k=rng.randint(2, 5))) for _ in range(400)]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def ordinary():
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(3, 300)) for _ in range(120)]
    passage = prose(rng, 60)
    texts += [t + " " + passage for t in texts[:10]]
    texts += texts[20:30] + [texts[20]] * 3
    for t in texts[30:45]:
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def awkward():
    rng = random.Random(9)
    long = prose(rng, 40_000)
    return [
        (1, "a plain text of a few words."), (1, "a plain text of a few words."), (1, "another text with the same id"), (None, "no id here"), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (7, "same " * 500), (8, "same " * 700),
        (9, "line\nline\nline\n"), (10, "Ünï códe  日本語 🙂 é \x00 \x1c <|endoftext|>"), (11, "  two  spaces \n\n and tabs\t\tend "), (12, "###$$$ %%% ||| <<< >>>"), (13, "word"), (-5, "negative id"), (2**62, "large id"), (14, "x" * 30_000),
    ]


@pytest.fixture(scope="session", params=["ordinary", "awkward", "empty"])
def corpus(request, spark):
    pairs = [] if request.param == "empty" else request.getfixturevalue(request.param)
    return pairs, make(spark, pairs)
