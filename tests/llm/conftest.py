import pytest

AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "The CAT sat on the mat and then it ran away from the big dog"),
    (6, "x The CAT sat on the mat and then it ran away from the big dog y"), (7, "one"), (8, "été 　 naïve 日本語 a\x1cb"),
    (9, "a|b|c 123 45.6 don't I'll  two   spaces \r\n end "), (10, "word " * 3000), (11, "z" * 5000),
    (12, "The CAT sat on the mat and then it ran away from the big dog"), (12, "The CAT sat on the mat and then it ran away from the big dog"),
    (None, "The CAT sat on the mat and then it ran away from the big dog"), (None, None), (0, "0 \u0085 \xa0   tail")]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, odd white space, and a column whose name clashes with inner ones."""
    rows = [(i, t, "n", 1, i, i) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, fp int, id long, slice long")


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.where("false")
