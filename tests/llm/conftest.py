import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node int, kept string, shard string, label string, `_row` int, rep int"


def prose(rng, n, lang="en"):
    """Invented prose of n words."""
    common = {"en": "the of and to in is that".split(), "fr": "le de et la les des".split()}[lang]
    return " ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def table(spark, rows):
    """Documents with columns whose names the operators also use."""
    return spark.createDataFrame([(*r, 1, "x", None, "y", "z", "l", 5, 6) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    original = prose(rng, 300)
    words = original.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "word", None, None), (None, prose(rng, 80), "en", "b"), (None, None, None, None),
        (5, original, "en", "a"), (6, original, "en", None), (7, near, "fr", "b"), (7, near, "fr", "b"), (8, prose(rng, 40) + " " + passage, "en", "a"),
        (9, passage + "\n" + prose(rng, 60), "en", "b"), (10, prose(rng, 20_000), "en", "c"), (-11, prose(rng, 500, "fr"), "fr", "c"), (12, "a b " * 400, "en", "a"),
        (2**40, "é " * 60 + "<|endoftext|> 😀, x.", "fr", "ü"), (13, "line one here\n" * 30, "en", "a"), (14, prose(rng, 60).upper() + " ###", "en", "a"),
    ]
    return rows + [(100 + k, prose(rng, rng.randint(5, 400)), "en", "abc"[k % 3]) for k in range(40)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])
