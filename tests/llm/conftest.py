import random

import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


def words(seed: int, n: int, vocab: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "tu", "ren", "sho", "é", "ßa"]) for _ in range(r.randint(1, 3)))
                    + str(r.randrange(vocab)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    long_text = "\n".join(words(k, 300) for k in range(40))
    base = words(7, 200)
    near = base.split(" ")
    near[50] = "changed"
    rows = [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (3, " ".join(near), "de", "a", 10),
        (4, None, "en", "a", None), (5, "", None, None, 0), (6, " \n\t ", "en", "b", 3),
        (7, long_text, "de", "b", len(long_text)), (8, long_text + " end", "de", "b", 1),
        (9, "one two", "fr", "c", 7), (10, "One  TWO", "fr", "c", 7), (11, "12345 !!! ...", "fr", None, 13),
        (12, words(99, 120) + "\nShared line of the site\n" + words(98, 50), "en", "a", 1),
        (13, "Shared line of the site", "en", "a", 1), (14, "Shared line of the site\n\nown words here", "en", "a", 1),
        (None, words(55, 60), "en", "a", 1), (9, "one two", "fr", "c", 7), (15, words(55, 60) + " tail", None, "a", 1),
        (16, "<|endoftext|> it's 's ''s  x　y\x1cZ Σ İ", "en", "c", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge_docs):
    """Extra columns with the names of results and helpers."""
    from pyspark.sql import functions as F

    names = ["ids", "decoded", "n_tokens", "n_bytes", "score", "lang_pred", "coverage", "topic", "doc", "n", "component",
             "kept", "runs", "line", "rank", "id", "copy", "weight", "prob", "_drop", "_host", "_kept", "_prob", "_weight", "_h",
             "_k", "_n", "_np", "site", "drop", "hits", "digest", "node", "other_id", "page", "of", "_id", "_text", "m_source"]
    out = edge_docs
    for name in names:
        out = out.withColumn(name, F.lit("x"))
    return out
