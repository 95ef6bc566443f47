import random

import pytest


def prose(rng, words=120, alphabet="etaoinshr"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9))) for _ in range(words))


#: Rows that every operator must stand: nulls, empty and odd texts, repeated rows, a very long text.
ODD = [(None, "no id at all"), (901, None), (902, ""), (903, " \n\t "), (904, "word"), (905, "!!! ### 123"), (906, "same row twice"), (906, "same row twice"), (907, "ab " * 30_000), (908, "x" * 60_000), (-5, "negative\x00id"), (909, "日本語 текст עברית 🙂")]


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    return [(i, prose(rng)) for i in range(1, 61)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Prose and odd rows, with columns whose names clash with those that operators make."""
    rows = [(i, t, "en", "s", 1, 0.5, 7, "x", 3) for i, t in texts + ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, fingerprint string, bucket int").cache()


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
