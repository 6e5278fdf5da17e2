import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, run int, fp long, part int, value long, words string, score double, id int, h string, kept boolean"


def hostile_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(30000))
    base = [
        (1, passage, "en", "b"), (2, passage + " ", "en", "a"), (3, passage.replace(" ", "\n"), "en", None), (4, None, None, None), (5, "", "de", "a"),
        (6, " \t\n", "fr", "a"), (7, long, "en", "a"), (8, long + "!", "en", "c"), (9, "one two", "en", "b"), (10, "TWO words", "en", "b"), (11, "two words", None, "b"),
        (12, "é 漢字 🙂 ß x", "es", "é"), (12, "é 漢字 🙂 ß x", "es", "é"), (None, "no id here at all", "en", "a"), (None, passage, None, "a"), (13, "x" * 5000, "en", "b"),
        (14, passage + " omega", "en", "c"), (15, "Released under the MIT License.", "en", "c"), (16, passage, "en", "b"),
    ]
    return [(i, t, lang, src, None if t is None else len(t), "k", 7, 1, 2, 3, 4, "w", 0.5, 6, "h", True) for i, t, lang, src in base]


@pytest.fixture(scope="session")
def hostile(spark):
    return spark.createDataFrame(hostile_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
