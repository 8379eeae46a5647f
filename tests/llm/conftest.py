from __future__ import annotations

import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "Omega", "zeta", "eta", "theta", "iota", "kappa", "straße", "über", "niño", "où", "déjà", "one-two", "x.y", "42"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def edge_rows(seed: int = 7, n: int = 60) -> list[tuple]:
    """Documents with nulls in every column, empty, tiny and long texts, exact and near copies, repeated rows and ids."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 120)), rng.choice(["en", "de", "fr", "es", None]), rng.choice(["a", "b", "c", None]), 1) for i in range(n)]
    base = rows[0][1] + " " + prose(rng, 80)
    for k in range(12):  # near copies: some words replaced
        w = base.split(" ")
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(w), "en", "a", 1))
    rows += [(200, None, "en", "a", None), (201, "", None, None, 0), (202, " \t\n ", "de", "b", 3), (203, "12 34 !!", "de", "b", 8), (204, "one two", "en", "c", 7), (205, "ONE two", "en", "c", 7)]
    rows += [(206, prose(rng, 6000), "en", "hot", 1), (207, "a\u0301 \u3042\u3044 \U0001f600 z", None, None, 1), (None, "a null id here with words enough", "en", None, 1)]
    rows += [rows[3], rows[3], (3, "another text for an id that is taken", "fr", "a", 1)]
    return rows


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(edge_rows(), KIND)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture
def clashing():
    """Adds columns with the names that operators use for their own."""
    from pyspark.sql import functions as F

    names = ["score", "predicted", "lang_pred", "held_out", "shard", "slot", "size", "mix_size", "mix_block", "component_id", "n_shingles", "key", "tokens", "kind", "host", "rule", "verdict", "alias", "id", "part", "ids", "place", "spans", "rank", "cell"]
    return lambda df: df.withColumns({n: F.lit("x") for n in names if n not in df.columns})
