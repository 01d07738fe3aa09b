import pytest

ODD_TEXTS = [None, "", " ", "\n\t ", "a", "one two", "Same text here, same text here.", "Same text here, same text here.", "ünïcödé ñandú Ångström ſtraße ΑΣ İstanbul", "a<|endoftext|>b <|startoftext|>", "it's we'll 'S x1y2 1234 don't—quote “q” \x1c \x85   z", "#### *** a\nb\na\n\na\n", "x" * 5000, "word " * 3000, "가나다 ㅏ 漢字かな é ́a", "<html> & | > 100%"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "s", len(t or ""), i, "x", 1.5) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[6], (None, "no id at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality long, _measured string, rank double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
