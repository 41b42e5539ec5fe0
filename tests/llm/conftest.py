import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, uid string, digest string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with names used inside the operators."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    long = " ".join(rng.choices(words, k=30000))
    base = rng.choices(words, k=80)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "one", "One", "o ne", "two words", "Two\twords", long, long + " tail", "é▁ß \U0001f600 x",
             "<|endoftext|> a  b\n c", "a\x00b c d e f g"]
    for k in range(60):
        copy = list(base)
        for _ in range(k % 6):
            copy[rng.randrange(80)] = rng.choice(words)
        texts.append(" ".join(copy))
    rows = [(i, t, "en", "s", None, "r", "u", "d") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "no id here at all", None, None, None, None, None, None), (None, None, None, None, 3, None, None, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
