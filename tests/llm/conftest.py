import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows and shared lines."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    text = lambda lines: "\n".join(line(rng.randint(5, 14)) for _ in range(lines))
    base = [text(rng.randint(1, 12)) for _ in range(40)]
    shared = [line(9) for _ in range(6)]
    texts = list(base)
    texts += [base[i] for i in (0, 0, 3, 3, 3, 7)]
    for i in range(12):
        part = base[i].split(" ")
        part[len(part) // 2] = rng.choice(words)
        texts.append(" ".join(part))
    texts += ["\n".join([text(2), *rng.sample(shared, 3), text(2)]) for _ in range(15)]
    texts += [None, "", " ", "\n\n", "one", "Ünïcödé ǅ ÀÉ", "x" * 5000, "ab " * 40_000, "a\x00b", "tab\tand\x0bvt"]
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[5], rows[6], (None, base[1], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("rest", "tk", "shared", "topic", "weight", "kept", "tokens", "score", "fp", "rep", "i", "t", "h", "batch", "label", "e")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    """All columns null."""
    return spark.createDataFrame([(None,) * 5] * 3, DOCS)
