import pytest

LONG = "lorem ipsum dolor sit amet " * 3000
COPY = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, COPY, "en", "a"), (2, COPY + " ", "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, " \n\t", "de", "b"), (6, LONG, "en", "b"), (7, LONG + "x", "en", "b"),
    (8, COPY, "en", None), (8, COPY, "en", None), (9, "!!! ???", "en", "a"), (10, "Ünïcödé ▁ text 中文 😀 <|endoftext|> <s>", "fr", "a"), (11, "a", "en", "a"), (None, "no id here at all", "en", "a"),
]
#: Columns whose names operators use inside.
EXTRA = "id string, row int, block string, label int, score double, name string, length int, y int, rank int, part int, place int, key string, count int"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns, read from files."""
    n = len(EXTRA.split(", "))
    path = f"file://{tmp_path_factory.mktemp('odd')}/documents"
    spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *[None] * n) for r in ROWS], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
