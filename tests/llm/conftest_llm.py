import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        *[T.StructField(c, T.StringType()) for c in ("key", "cid", "label", "row", "hash", "_b", "_q0", "_d", "a.b")],
    ]
)


def frame(spark, rows):
    """Documents from (id, text) or (id, text, lang), with clashing extra columns."""
    full = []
    for row in rows:
        i, text, lang = (*row, None)[:3]
        full.append((i, text, lang, None, None if text is None else len(text), *["x"] * 9))
    return spark.createDataFrame(full, DOCS)


ODD = [
    (None, "a lone id that is null, said the text about nothing at all"),
    (None, None),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "!!! ### ---"),
    (7, "same words in the same row, twice over and again"),
    (7, "same words in the same row, twice over and again"),
    (8, "same words in the same row, twice over and again"),
    (9, "word " * 30_000),
    (10, "x" * 50_000),
    (11, "日本語のテキスト 😀 İstanbul Σίσυφος é <|endoftext|> '́s don't"),
    (12, "mail me at someone.else@mail.example.org or +1 (555) 010-4477 190.20.30.40 now"),
    (-(1 << 62), "low"),
    ((1 << 62), "high"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
