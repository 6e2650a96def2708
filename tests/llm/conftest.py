import random

import pytest

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which".split()


@pytest.fixture(scope="session")
def prose():
    """A maker of texts of so many words, different for each seed."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed"]) + str(rng.randrange(40)) for _ in range(n))

    return make


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Documents with nulls, empty and long texts, ties, repeats, and columns with names that operators use inside."""
    base = prose(120, 1)
    changed = base.split()
    changed[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(changed), "en", "b"), (4, prose(90, 2), "en", None), (5, "", "en", "b"),
        (6, None, "en", "b"), (7, "One", None, "c"), (8, "one", "de", "c"), (9, prose(4000, 3), "fr", "a"), (10, "  \n\t ", "fr", "d"),
        (11, "é中😀 ß  x", "fr", "d"), (11, "é中😀 ß  x", "fr", "d"), (None, prose(30, 4), "en", "a"), (12, base.upper(), "en", "a"),
    ]
    made = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    df = spark.createDataFrame(made, DOC)
    for c in ("id", "n", "k", "block", "score", "key", "a", "b", "label", "size"):
        df = df.selectExpr("*", f"'extra' as {c}")
    return df
