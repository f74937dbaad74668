import pytest

#: Nulls, empty and blank texts, repeated rows, a long text, and columns that clash with names used inside.
LONG = " ".join(f"w{i * i % 997}" for i in range(3000))
COPY = " ".join(f"copy{i}" for i in range(80))
ROWS = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t ", None),
    (4, "One two three.", "de"),
    (5, COPY + " tail of five", "en"),
    (6, "head of six " + COPY, "en"),
    (7, COPY + " tail of five", "en"),
    (7, COPY + " tail of five", "en"),
    (8, LONG, "fr"),
    (9, LONG + " and more", "fr"),
    (10, "it's don't 'LL 12 ½ 世界 😀\n\nx  y ", "es"),
    (None, "a row without a key " + COPY, "en"),
    (11, "mail bob@example.com or +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111", "en"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(k, t, lang, 1, "x", 2.0) for k, t, lang in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block int, words string, n_words double").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("1 = 0")


def texts():
    return [t or "" for _, t, _ in ROWS]
