import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, short, long and repeated texts, ties, and columns with clashing names."""
    long = " ".join(f"word{k % 977} token{k % 53}" for k in range(12_000))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, None, None),
        (3, "one", "en", "a", 3),
        (4, long, "en", "b", len(long)),
        (5, long, "en", "b", len(long)),
        (5, long, "en", "b", len(long)),
        (6, "Ünïcode 中文字 \U0001f600 text\n\nwith  spaces \t and ends ", "xx", "c", 5),
        (None, "no id here at all my friend", "en", "a", 1),
        (None, None, None, None, None),
        (7, "   \n\t ", "en", "a", 6),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOC + ", mark string, k long")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
