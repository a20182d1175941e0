import pytest

WORDS = ("river stone market window garden letter morning captain silver bridge forest lantern "
         "harbour winter kitchen orange station mirror valley thunder candle pocket meadow "
         "anchor ribbon copper island feather castle marble").split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with columns that clash with names the operators use."""

    def make(rows):
        schema = ("doc_id long, text string, lang string, source string, n_chars long, "
                  "row long, key string, rec string")
        return spark.createDataFrame(
            [(d, t, None, "s", None if t is None else len(t), 1, "k", None) for d, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and wordless texts, ties, repeated rows, a very long text."""
    long = prose(1, 40_000)
    return [(None, None), (1, ""), (2, None), (3, "  \n\t "), (4, "!!! ???"), (5, "one"),
            (6, "é ü 漢字 \U0001F600 ß"), (7, prose(7, 60)), (7, prose(7, 60)), (8, prose(7, 60)),
            (None, prose(9, 30)), (9, long), (10, "x" * 5000), (11, "0" * 3000), (12, "a@b.c" * 50)]
