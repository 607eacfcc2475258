from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabscout.functions import names
from tabscout.functions import words as w


def one(spark, name, expr):
    return spark.createDataFrame([(name,)], "name string").select(expr(F.col("name"))).first()[0]


@pytest.mark.parametrize(("name", "label"), [
    ("pclass", "Passenger Class"), ("SibSp", "Siblings/Spouses"), ("parch", "Parents/Children"),
    ("order_id", "Order ID"), ("api-url  list", "API URL List"), ("  first__name ", "First Name"),
    ("US", "US"), ("us", "Us"), ("l_quantity", "L Quantity"), ("lat", "Latitude"),
    ("roomTYPE", "Roomtype"), ("x" * 80, "X" + "x" * 63),
])
def test_human_label(spark, name, label):
    assert one(spark, name, names.human_label) == label


@pytest.mark.parametrize(("name", "is_id"), [
    ("paid", True), ("valid", True), ("bid", True), ("id_card", True), ("zip", True),
    ("user_key", True), ("custkey", False), ("ideal", False), ("grade", False),
])
def test_identifier_names(spark, name, is_id):
    assert one(spark, name, names.name_is_id) is is_id


def test_words_inside_names(spark):
    def has(words):
        return lambda c: names.name_has(c, words)
    # Five letters and more match inside, shorter ones only as a piece.
    assert one(spark, "o_orderstatus", has(w.OUTCOME_WORDS))
    assert one(spark, "o_orderstatus", has(w.SUM_WORDS)) is True
    assert one(spark, "l_shipdate", has(w.DATE_WORDS)) is False
    assert one(spark, "created_at", has(w.DATE_WORDS)) is True
    assert one(spark, "long_description", has(w.LONGITUDE_WORDS)) is True
    assert one(spark, "platitude", has(w.LATITUDE_WORDS)) is True
    assert one(spark, "plateau", has(w.LATITUDE_WORDS)) is False


@pytest.mark.parametrize(("name", "agg"), [
    ("total_sales", "sum"), ("sales_rate", "sum"), ("rating", "mean"), ("age", "mean"),
    ("ticket_price", "median"), ("value", "median"), ("height", "mean"), ("package", "mean"),
])
def test_default_agg(spark, name, agg):
    assert one(spark, name, names.default_agg) == agg


def test_bad_axis(spark):
    assert one(spark, "p_name", names.name_is_bad_axis)
    assert one(spark, "last_review", names.name_is_bad_axis)
    assert one(spark, "descriptions", names.name_is_bad_axis)
    assert not one(spark, "room_type", names.name_is_bad_axis)
