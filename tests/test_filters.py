import pytest
from pyspark.sql import functions as F

from tessella.functions.filters import compile_filter, date_range, parse_filters
from tessella.operators.collection import metadata_of
from tessella.schema import META


def matches(spark, metadata, conditions):
    df = spark.createDataFrame([(metadata_of(metadata),)], f"metadata map<string,{META}>")
    return df.select(compile_filter(conditions, F.col("metadata")).alias("y")).first()["y"]


def test_parsing():
    assert parse_filters(["status=2", "published=true", "author=Alice", "zip=007", "x=-1.5", "a=1", "a=b=c"]) == {"status": 2, "published": True, "author": "Alice", "zip": "007", "x": -1.5, "a": "b=c"}
    assert parse_filters(['{"$or": [{"a": 1}, {}]}']) == {"$or": [{"a": 1}, {}]}
    assert parse_filters([]) == parse_filters(None) == {}


@pytest.mark.parametrize("bad", [["status"], ['{"$or": {"a": 1}}'], ['{"status": {"$eq": 2}}'], ['{"a": null}'], ["=x"], ["{"], ['{"": 1}'], ['{"$or": [1]}']])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        parse_filters(bad)


@pytest.mark.parametrize("metadata, conditions, expected", [
    ({"x": 1}, {"x": 1}, True), ({"x": 1.0}, {"x": 1}, True), ({"x": True}, {"x": 1}, True), ({"x": "1"}, {"x": 1}, True), ({"x": "1.0"}, {"x": 1}, False), ({"x": "true"}, {"x": 1}, False),
    ({"x": True}, {"x": True}, True), ({"x": 1}, {"x": True}, True), ({"x": "TRUE"}, {"x": True}, True), ({"x": "1"}, {"x": True}, False), ({"x": 2.0}, {"x": 2}, True), ({"x": "2.0"}, {"x": 2}, False),
    ({"author": "alice"}, {"author": "Alice"}, True), ({"author": "alice"}, {"author": "lic"}, False), ({"portal": "80000083721"}, {"portal": 80000083721}, True), ({}, {"x": 1}, False), ({"x": 1}, {}, True),
    ({"a": 1}, {"$or": []}, False), ({"a": 1}, {"$or": [{}]}, True), ({"a": 1, "b": 2}, {"$or": [{"a": 9}, {"$or": [{"b": 2}]}]}, True), ({"a": 1}, {"a": 1, "$or": [{"a": 2}]}, False),
])
def test_equality(spark, metadata, conditions, expected):
    assert matches(spark, metadata, conditions) is expected


def test_core_fields_and_dates(spark):
    rows = [("1", "git", {"date": "2026-05-10 23:59:00 -0700"}), ("2", "slack", {"date": "2026-04-30"}), ("3", "slack", {}), ("4", "git", {"date": "2026"})]
    df = spark.createDataFrame([(i, s, metadata_of(m)) for i, s, m in rows], f"id string, source string, metadata map<string,{META}>")
    pick = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert pick(compile_filter({"source": "GIT"}, F.col("metadata"), core=True)) == ["1", "4"]
    assert pick(date_range(F.col("metadata"), "2026-05-10")) == ["1"] and pick(date_range(F.col("metadata"), None, "2026-05-10")) == ["2"]
    assert pick(date_range(F.col("metadata"))) == ["1", "2", "3", "4"]
