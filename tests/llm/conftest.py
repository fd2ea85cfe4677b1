import pytest

from tenure.llm.shared import package_on_workers

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sp(spark):
    package_on_workers(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(sp):
    """Nulls in every column, empty and long texts, repeated rows, repeated ids and clashing extra columns."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
    prose = " ".join(f"alpha{i} beta{i % 7} gamma" for i in range(40))
    rows = [(1, prose, "en", "a", 5), (1, prose, "en", "a", 5), (2, prose + " more", "en", "a", None), (3, None, None, None, None),
            (4, "", "en", "b", 0), (5, " \t\n ", None, "b", 4), (None, "some text without an id", "fr", None, 3), (6, long, "de", "a", 1),
            (7, "ein kurzer Satz", "de", "a", 1), (7, "another text, same id", "en", "c", 1), (8, "123 !!! ###", "en", "c", 2), (9, "été", "fr", "c", 2)]
    rows = [(*r, 1.5, "x", "y", "z") for r in rows]
    return sp.createDataFrame(rows, DOC + ", score double, topic string, size string, kept string")
