import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run int, digest string, spans string, row string, kept string, rank int, `odd.name` string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with further columns whose names clash with working ones."""

    def make(pairs, partitions=3):
        rows = [(i, t, "en", "s", len(t) if t is not None else None, 1, "d", "s", "r", "k", 2, "o") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(partitions)

    return make


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def hard_pairs():
    """Nulls, blanks, repeats, ties, a hot group, near copies, shared passages, one long text."""
    rng = random.Random(11)
    base = words(rng, 300, 5000)
    near = list(base)
    near[7] = "changed"
    passage = words(rng, 80, 5000)
    pairs = [(1, None), (2, ""), (3, " \t\n"), (None, "null id text"), (None, None), (4, "a b"), (5, "a  b"), (5, "a  b"), (6, "a b "), (7, "ä ö ü ß 日本 ​x"), (8, "x" * 5000)]
    pairs += [(20, " ".join(base)), (21, " ".join(near)), (22, "\n".join(base)), (23, " ".join(base[:150] + words(rng, 10, 5000) + base[150:]))]
    pairs += [(30 + k, " ".join([*words(rng, 60, 5000), *passage, *words(rng, 60, 5000)])) for k in range(6)]
    pairs += [(50, " ".join(words(rng, 9000, 3000))), (51, "one two " * 400), (52, "same " * 120)]
    pairs += [(100 + k, "hot copy of one text " * 15) for k in range(40)]
    pairs += [(200 + k, " ".join(words(rng, rng.randrange(1, 400), 900))) for k in range(40)]
    return pairs
