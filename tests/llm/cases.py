"""Fixtures of these tests; imported by them, since a second conftest would hide the first."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, counts string, pii string, slot long, key string, tokens string, part int, _words string, h1 long"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("needs the driver's tables")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    """(doc_id, text) of the driver's smallest table, whole."""
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]


def rows_of(pairs):
    """Documents with extra columns whose names clash with internal ones."""
    return [(i, t, lang, source, None, 1, "c", "p", 2, "k", "t", 3, "w", 4) for i, t, lang, source in pairs]


EDGE_TEXTS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n\r\x0b\x0c ", "en", None),
    (4, "one", "en", "a"),
    (5, "One two three four five six seven eight nine ten eleven. " * 30, "en", "a"),
    (5, "One two three four five six seven eight nine ten eleven. " * 30, "en", "a"),
    (6, "One two three four five six seven eight nine ten eleven. " * 30, "en", "b"),
    (None, "a row without an id has some words of its own to count here", "en", "b"),
    (None, None, None, "b"),
    (7, "naïve Ünïcödé 　 wörds  😀 İ ſ K ß 中文字 é", "de", "c"),
    (8, "word " * 20_000, "en", "c"),
    (9, "a" * 3_000, "xx", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows_of(EDGE_TEXTS), SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
