from __future__ import annotations

import random

import pytest

WORDS = "the and ing over rain tion stone river green cloud a of to in it was for on as with that bright road night hill sea".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ly", "ed", str(rng.randint(0, 99))]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars, extra columns): nulls, empty and very long texts, copies, near copies, ties."""
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([3, 25, 60, 140])) for _ in range(60)]
    passage = prose(rng, 40)
    texts += [texts[3], texts[3], texts[3], texts[7].replace(" ", "  "), texts[9] + " extra", passage + " " + texts[11], texts[12] + "\n" + passage, passage]
    texts += [None, "", " \t\n", "one", "Ünïcödé ß 日本語 🙂 text", "line one here\n" * 40, "spam!! " * 300, prose(rng, 9000), "x" * 30_000, "a b c\x0bd\x0ce\rf"]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 3}" if i % 10 else None, len(t) if t is not None else None, i, "kept", "x") for i, t in enumerate(texts)]
    return [*out, (5, texts[5], "en", "src2", len(texts[5]), 5, "kept", "x")]  # a repeated row


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot string, _id string"


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
