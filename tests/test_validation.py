import json

import pytest
from pyspark.sql import functions as F

from corkscan.operators import validation as v

RECORD = {
    "points": "90", "title": "T", "description": "d", "taster_name": "K", "taster_twitter_handle": "@k", "price": 30,
    "designation": "R", "variety": "V", "region_1": "C", "region_2": None, "province": "P", "country": "Italy",
    "winery": "W", "id": 7,
}


def line(*without, **changed):
    record = {**RECORD, **changed}
    return json.dumps({k: x for k, x in record.items() if k not in without})


def check(spark, *lines, fill=v.FILL_FALSY):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i INT, raw STRING")
    return v.check_records(rows, fill).orderBy("i").collect()


def test_types_are_coerced(spark):
    a, b, c = check(spark, line(), line(points="91.0", price="12.5"), line(points=92, price=None, id="8"))
    assert (a.id, a.points, a.price, a.reasons) == (7, 90, 30.0, [])
    assert (b.points, b.price, b.reasons) == (91, 12.5, [])
    assert (c.id, c.points, c.price, c.reasons) == (8, 92, None, [])


@pytest.mark.parametrize("text, reasons", [
    (line(points="x"), ["points"]),
    (line(points=90.5), ["points"]),
    (line(points="9e1"), ["points"]),
    (line(points=None), ["points"]),
    (line(title=None), ["title"]),
    (line(title=5), ["title"]),
    (line(winery=["W"]), ["winery"]),
    (line(price="30d"), ["price"]),
    (line("price"), ["missing price"]),
    (line("designation"), ["missing vineyard"]),
    (line("price", points="x"), ["points", "missing price"]),
    (line(country=5), ["country"]),
    ("not json", [v.NOT_A_RECORD]),
    ("[1, 2]", [v.NOT_A_RECORD]),
])
def test_broken_rules_are_named(spark, text, reasons):
    assert check(spark, text)[0].reasons == reasons


def test_missing_is_not_null(spark):
    a, b = check(spark, line(price=None), line("price"))
    assert a.reasons == [] and b.reasons == ["missing price"]


def test_either_name_of_the_vineyard(spark):
    a, b, c = check(spark, line(), line("designation", vineyard=" vv "), line(vineyard="own", designation=None))
    assert [a.vineyard, b.vineyard, c.vineyard] == ["R", "vv", None]
    assert all(not r.reasons and not r.extras for r in (a, b, c))


@pytest.mark.parametrize("fill, expected", [
    (v.FILL_FALSY, ["Unknown", "Unknown", "Unknown", "null", "", "Italy"]),
    (v.FILL_NULL_LITERAL, ["Unknown", "Unknown", "", "Unknown", "", "Italy"]),
])
def test_country_is_filled_before_it_is_stripped(spark, fill, expected):
    lines = [line(country=None), line("country"), line(country=""), line(country="null"), line(country="  "),
             line(country=" Italy ")]
    rows = check(spark, *lines, fill=fill)
    assert [r.country for r in rows] == expected
    assert all(r.reasons == [] for r in rows)


def test_unknown_rule_is_an_error(spark):
    with pytest.raises(ValueError):
        check(spark, line(), fill="other")


def test_embedding_text_keeps_inner_spaces(spark):
    a, b, c = check(spark, line(variety=None, title="T  x "), line(variety="", title="", description=None), line())
    assert [a.to_vectorize, b.to_vectorize, c.to_vectorize] == ["T  x  d", "", "V T d"]
    assert a.title == "T  x" and b.title == ""


def test_extras_pass_through(spark):
    a, = check(spark, line(vintage=2001, note=None, deep={"a": [1]}))
    assert {key: value.toPython() for key, value in a.extras.items()} == {"vintage": 2001, "note": None, "deep": {"a": [1]}}


def checked(spark, *lines):
    return v.check_records(spark.createDataFrame([(x,) for x in lines], "raw STRING"))


def test_outcomes(spark):
    rows = checked(spark, line(), line(points="x"), line(id=8))
    assert sorted(r.id for r in v.accepted(rows).collect()) == [7, 8]
    assert [r.reasons for r in v.rejected(rows).collect()] == [["points"]]
    with pytest.raises(Exception, match="invalid record \\(points\\)"):
        v.fail_fast(rows).count()
    assert v.fail_fast(checked(spark, line())).count() == 1


def test_document_key(spark):
    row = v.with_document_key(v.accepted(checked(spark, line()))).first()
    assert row._id == "7" and row.id == 7 and "to_vectorize" not in row.asDict()


def test_dump(spark):
    records = v.accepted(checked(spark, line(price=None, vintage=2001, note=None, tags=["a", 1.5, True], deep={"a": None})))
    kept = json.loads(v.dump_records(records).first().json)
    dropped = json.loads(v.dump_records(records, keep_nulls=False).first().json)
    assert kept["price"] is None and kept["region_2"] is None and kept["note"] is None and kept["vintage"] == 2001
    assert kept["tags"] == ["a", 1.5, True] and kept["deep"] == {"a": None}
    assert list(kept)[:3] == ["id", "points", "title"] and kept["vineyard"] == "R"
    assert dropped == {k: x for k, x in kept.items() if x is not None}


def test_search_types(spark):
    row = v.search_types(v.accepted(checked(spark, line()))).select("id", "points", "price")
    assert row.dtypes == [("id", "string"), ("points", "decimal(20,0)"), ("price", "double")]
    assert row.first().id == "7"


def test_filters_do_not_repeat_the_checks(spark):
    """The plan stays small however many filters follow."""
    reasons = v.rejected(checked(spark, line())).select(F.explode("reasons"))
    plan = reasons._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
