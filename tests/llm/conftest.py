import pytest


@pytest.fixture()
def docs_of(spark):
    """Documents with nulls, ties and columns whose names the operators also use."""

    def make(rows):
        kind = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, size string, target string, copies string, n_lines string, root string, fp string, row string, toxic string, whole string, key string"
        return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, *"1234567890") for i, t, lang, s in rows], kind)

    return make
