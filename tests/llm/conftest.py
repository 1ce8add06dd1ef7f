import random

import pytest

#: Column names that helper columns of the operators have, or had.
CLASHES = ["row", "digest", "node", "id", "doc", "slot", "at", "key", "keys", "p", "new", "spans", "_id", "_text", "class", "kept", "clean", "length"]


@pytest.fixture(scope="session")
def path():
    return lambda name: f"/opt/tokenizers/{name}"


def make(spark, rows, extra=True):
    """A documents table of (doc_id, text) with columns whose names clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASHES if extra)
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), *(["x"] * len(CLASHES) if extra else [])) for i, t in rows], schema)


def prose(rng: random.Random, n: int) -> str:
    parts = "the tion and ing er st re on en at or is ed ha it ou ea to ti th".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls anywhere, empty texts, white space, ties, repeated rows, a very long text, unusual characters."""
    rng = random.Random(4)
    long = prose(rng, 12_000)
    shared = prose(rng, 80)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, prose(rng, 300)), (4, "another text under one id"), (5, long), (6, long), (7, "same row"), (7, "same row"), (7, "same row"),
            (None, "no id"), (None, None), (8, "é ß 😀 　 x́ <|endoftext|> İ"), (9, "word " * 400), (10, "x" * 30_000), (11, prose(rng, 60) + " " + shared), (12, shared + " " + prose(rng, 60)),
            (13, 'key = "' + "0123456789abcdef" * 3 + '" here'), (14, "a\x1cb\x85c\r\nd")]
    return make(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
