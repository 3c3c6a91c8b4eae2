import pytest
from pyspark.sql import functions as F

from corkscan.functions import text


def column(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, x STRING")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]


def test_strip_takes_all_white_space(spark):
    assert column(spark, text.strip, "\t a  b\xa0　", "  ", "", None, " x\x85") == ["a  b", "", "", None, "x"]


def test_prefixes(spark):
    assert column(spark, text.document_text, " Ripe ÉTÉ\n") == ["search_document: ripe été"]
    assert column(spark, text.query_text, "Apple Pear ") == ["search_query: apple pear"]


def test_tokens(spark):
    found = column(spark, text.tokens, "Don't pay 3.14, Ça_va!", "", None, "—")
    assert found == [["don", "t", "pay", "3", "14", "ça_va"], [], [], []]


def test_joined_tokens(spark):
    found = column(spark, lambda c: text.tokens(c, joined=True), "Don't pay 3.14, l’été. 1,000 'x' a.b")
    assert found == [["don't", "pay", "3.14", "l’été", "1,000", "x", "a", "b"]]


@pytest.mark.parametrize("space", list(text.WHITE_SPACE))
def test_white_space_is_that_of_python(space):
    assert space.isspace()
