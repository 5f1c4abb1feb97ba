"""A small table with everything that is awkward in it."""

import pytest

WORDS = "the sun rose over a quiet harbour while two old boats drifted slowly past the grey stone wall and nobody spoke of rain".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i // 3) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars, size, shard): nulls, empties, ties, repeats, a long text, clashing columns."""
    long = "\n".join(prose(k, 40) for k in range(300))
    shared = prose(99, 60)
    texts = [None, "", " ", "\n\n", "one", "Two words", prose(1, 80), prose(1, 80).upper(), prose(1, 80) + " tail", shared + "\n" + prose(2, 50)]
    texts += [prose(3, 50) + "\n" + shared, long, long + " end", "Straße über Ähren É", "same line\nsame line\n Same LINE \nother"] + ["same line\n" + prose(40 + k, 20) for k in range(12)]
    rows = [(k, t, ["en", "de", None][k % 3], ["b", "a", None][k % 3], 1, "x", 7) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, prose(1, 80), "en", "a", 1, "x", 7), (None, None, None, None, None, None, None), (5, prose(8, 70), "en", "b", 1, "x", 7)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long, size string, shard int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -1")
