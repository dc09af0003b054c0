"""A small corpus with all awkward rows, for every operator."""

import random

import pytest

WORDS = "the of and to in is on that by this with as for are be at from it or an".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "ly", "é"]) for _ in range(n))


def make_rows():
    """(doc_id, text, source): copies, near copies, shared lines and passages, nulls, empty and long texts."""
    rng = random.Random(5)
    passage = sentence(rng, 60)
    lines = [f" Shared Line {k}\t" for k in range(3)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            parts.insert(rng.randrange(len(parts) + 1), lines[i % 3].upper() if i % 8 else lines[i % 3])
        if i % 9 == 0:
            parts.append(passage)
        rows.append((i, "\n".join(parts), f"s{i % 5}" if i % 7 else None))
    rows += [(100 + k, rows[3][1], "s1") for k in range(12)]  # copies
    words = rows[9][1].split(" ")
    rows += [(120 + k, " ".join([*words[: 5 * k], "other", *words[5 * k + 1 :]]), "s2") for k in range(6)]  # near copies
    rows += [(130, None, "s1"), (131, "", "s1"), (132, "", None), (133, " \n\t\n ", "s0"), (134, "one", "s0"), (135, "one", "s0")]
    rows += [(None, rows[20][1], "s3"), (None, "without an id " * 20, None), (136, rows[3][1], "s1"), (136, rows[3][1], "s1")]
    rows += [(137, " ".join(sentence(rng, 50) for _ in range(80)), "s4"), (138, "aaaa" * 300, "s4"), (139, "x\n" * 500, "s4"), (140, "ÄÖ # * | <b> ü" * 30, "s0")]
    return rows


CLASHING = ["size", "taken", "key", "row", "n_words", "copies", "block", "words", "_text", "spans", "value"]


def frame(spark, rows, schema="doc_id long, text string, source string"):
    """The rows with columns that operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def docs_rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return frame(spark, docs_rows).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])
