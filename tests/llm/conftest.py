import pytest


@pytest.fixture()
def docs(spark):
    """Documents with further columns, one of them named like an operator's own."""

    def make(*rows):
        full = [(i, text, lang, source, None if text is None else len(text), 1) for i, text, lang, source in ((*r, "en", "s")[:4] for r in rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, digest int")

    return make


@pytest.fixture()
def sample(spark):
    return "/root/testdata/sf0.001"
