import pytest

#: Rows with what every operator must bear: nulls, empty and long texts, ties, repeated rows.
HARD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, None),
    (3, ""),
    (4, "word"),
    (5, "   \n\t "),
    (6, "Éa ça İstanbul Σίσυφος naïve coöperate straße ﬁx é ​ x y \x1c z"),
    (7, "long text " * 6000),
    (8, "<|endoftext|> don't we'll 12345 $$$ ### ..."),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (None, "no id here at all, but five words"),
]


@pytest.fixture(scope="session")
def hard(spark):
    rows = [(i, t, "en", "s", 0, "x") for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
