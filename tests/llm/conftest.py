import pytest

WORDS = "la de un cable rojo azul metro tubo caja par norte sur este uno dos tres cuatro cinco seis siete ocho nueve diez".split()


@pytest.fixture
def documents(spark):
    """Makes a table of documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(pairs):
        rows = [(i, t, None if k % 5 == 4 else f"s{k % 3}", "x", "clash") for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, size string")

    return make


@pytest.fixture
def awkward(documents):
    """Null, empty and very long texts, ties, repeated rows, a null id."""
    long = " ".join(WORDS[k * k % len(WORDS)] for k in range(30_000))
    same = "uno dos tres cuatro cinco seis siete ocho"
    return documents([(1, None), (2, ""), (3, "   \n"), (4, long), (5, same), (6, same), (6, same), (None, "sin id pero con texto de mas de cinco palabras"), (8, "É ß \U0001d518 中文"), (9, "hi")])


@pytest.fixture
def empty(documents, awkward):
    return awkward.where("false")


def prose(rng, n):
    return [WORDS[k] for k in rng.integers(0, len(WORDS), n)]
