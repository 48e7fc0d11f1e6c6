"""Documents with every kind of trouble, and random prose with planted copies."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string, topic string"


def frame(spark, texts, langs=None, sources=None):
    """Documents with extra columns whose names clash with results."""
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "x", None, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda *a, **k: frame(spark, *a, **k)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [prose(rng, rng.randint(1, 90), words) for _ in range(60)]
    out = list(base)
    for t in base[:20]:  # near copies with some words changed
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append(" ".join(v))
    shared = prose(rng, 60, words)
    out += [f"{prose(rng, 5, words)} {shared} {prose(rng, k, words)}" for k in range(8)]
    out += ["", None, " \n\t ", "one two", "One  TWO", "one two three four", "É é É é É é", base[0] + "\n", base[0].replace(" ", "  "), "x" * 5000, "ab " * 3000]
    return out


@pytest.fixture(scope="session")
def docs(make, texts):
    return make(texts)
