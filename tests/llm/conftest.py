import pytest
from corpus_text import changed, prose


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """doc_id, text, lang, source: copies, near copies, edge cases."""
    rows = [prose(i, 20 + 13 * i % 300) for i in range(30)]
    rows += [rows[0], rows[0], rows[3].upper(), None, "", "  \n\t ", "one", "one two three", "one two three", "été ß ñ 日本語 🙂 été ß ñ", "a" * 400, "a" * 300]
    rows += [changed(rows[i], 50 + i + j, s) for i in range(10, 22) for j, s in enumerate((0.005, 0.01, 0.03, 0.08))]
    rows += [prose(900, 6000), changed(prose(900, 6000), 1, 0.01)]
    rows += ["12345 !!! 777", "x\x0by z\x0cw q r s t"]
    out = [(i * 3 + 1, t, ("en", "fr", None)[i % 3], None if i % 7 == 0 else f"s{i % 4}") for i, t in enumerate(rows)]
    return [*out, out[5]]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(*t, 7, "clash", 1.5) for t in texts], "doc_id long, text string, lang string, source string, n_chars long, bands string, size double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
