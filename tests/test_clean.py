"""Goldens for the scalar cleaning functions (P5-P12), taken from the reference's unit tests."""
import datetime

from pyspark.sql import functions as F

from loupe.functions import clean as P


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_sanitize_text(spark):
    assert one(spark, P.sanitize_text, None) == ""
    assert one(spark, P.sanitize_text, "\nthis has\r many strange \n linebreaks and \r stuff") == \
        "this has many strange linebreaks and stuff"
    assert one(spark, P.sanitize_text, "\nthis has\rmany strange\nlinebreaks and\rstuff") == \
        "this has many strange linebreaks and stuff"
    assert one(spark, P.sanitize_text, "  this  is  a  string  ") == "this is a string"
    assert one(spark, P.sanitize_text, "foo") == "foo"


def test_sanitize_number(spark):
    assert one(spark, P.sanitize_number, None) == 0
    assert one(spark, P.sanitize_number, "2005-12-09") == 732289
    assert one(spark, P.sanitize_number, "foo") == 0
    assert one(spark, P.sanitize_number, "1.75") == 1.75
    assert one(spark, P.sanitize_number, "10") == 10


def test_to_ordinal(spark):
    assert one(spark, P.to_ordinal, datetime.date(2005, 12, 9), "date") == 732289
    assert one(spark, P.to_ordinal, datetime.date(1, 1, 1), "date") == datetime.date(1, 1, 1).toordinal()


def test_predicates(spark):
    for v, f_, i_, s_ in [("1.5", True, False, False), ("abc", False, False, True), ("5", True, True, False),
                          ("2004-05-09", False, False, False)]:
        assert one(spark, P.is_float, v) is f_, v
        assert one(spark, P.is_int, v) is i_, v
        assert one(spark, P.is_str, v) is s_, v


def test_parse_datetime_multi(spark):
    for v in ["2004-04-12 12:34:17", "2005-03-19", "2005-03-19 12:34:17.000001", "24/11/2024 15:18:11",
              "19/03/2022", "11/2/2024 15:18:11", "12/3/2022"]:
        assert one(spark, P.parse_datetime_multi, v) is not None, v
    assert one(spark, P.parse_datetime_multi, "not a date") is None


def test_labels_and_keys(spark):
    assert one(spark, P.is_unlabelled, None) is True
    assert one(spark, P.is_unlabelled, "") is True
    assert one(spark, P.is_unlabelled, "a") is False


def test_dates_are_parsed_only_where_the_marks_fit(spark):
    """A failed parse throws; before, every text went through all twelve parsers."""
    assert str(P.parse_datetime_multi("x")).lower().count("like(") == len(P.DATETIME_FORMATS)
    values = ["{\"k\": 69}", "12.5", "1-2-3", "-1e-05", " 2005-12-09 ", "31/12/2005 1:02:03,123456", "2005-12-9 1:2:3", "20051209", "", "2/31/2005", "12/31/2005"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("x"), F.lit(fmt)) for fmt in P.DATETIME_FORMATS])
    assert df.where(~P.parse_datetime_multi("x").eqNullSafe(plain)).count() == 0
    assert [r.n for r in df.select(P.sanitize_number("x").alias("n")).collect()][:4] == [0.0, 12.5, 0.0, -1e-05]
