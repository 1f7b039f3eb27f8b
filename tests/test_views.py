import hashlib

import pytest
from conftest import make_corpus
from pyspark.sql import functions as F

from tabscout.functions import hashing, names, views


def text(spark, view, table):
    return make_corpus(spark, [table]).select(views.serialize(view).alias("x")).first().x


TWO = ("d", "t", ["a", "b"], [["1", "2"], ["3", "4"]], [])


@pytest.mark.parametrize("view,table,expected", [
    ("row", TWO, "[TABLE]t [ROWS][ROW] a:1 | b:2[ROW] a:3 | b:4"),
    ("schema", TWO, "[TABLE]t [SCHEMA]a,b"),
    ("full", TWO, "[DB]d [TABLE]t [SCHEMA]a,b [ROWS]1,2|3,4"),
    ("document", TWO, "[TABLE]t [SCHEMA]a,b [ROWS]1,2|3,4"),
    ("simple", TWO, "[TABLE] t [SCHEMA] a, b [ROWS] 1 | 2 3 | 4"),
    ("keyvalue", TWO, "a: 1 b: 2 a: 3 b: 4"),
    ("full", ("d", "t", ["a", "b"], [], []), "[DB]d [TABLE]t [SCHEMA]a,b [ROWS]"),
    ("row", ("d", "t", ["a"], [], []), "[TABLE]t [ROWS]"),
    ("schema", ("d", "t", [], [], []), "[TABLE]t [SCHEMA]"),
    ("simple", ("d", "t", ["a"], [], []), "[TABLE] t"),
    ("full", ("d", "t", ["a", "b"], [[None, "x,y"]], []), "[DB]d [TABLE]t [SCHEMA]a,b [ROWS],x,y"),
    ("row", ("d", "t", ["a", "b"], [["1"]], []), "[TABLE]t [ROWS][ROW] a:1 | b:"),
])
def test_view_text(spark, view, table, expected):
    assert text(spark, view, table) == expected


def test_unknown_view():
    with pytest.raises(ValueError):
        views.serialize("nope")


def test_fan_out(spark):
    out = views.fan_out(make_corpus(spark, [TWO]), ["full", "schema"]).collect()
    assert {r.view for r in out} == {"full", "schema"} and len(out) == 2


@pytest.mark.parametrize("doc,expected", [
    (([["0", "a"], ["0", "b"]], None, [["1", "2"]], None), "[TABLE]t [SCHEMA]a,b [ROWS]1,2"),
    (([], None, [["1"]], None), "[TABLE]t [SCHEMA]unknown [ROWS]1"),
    ((None, ["h"], None, [["1"], ["2"], ["3"], ["4"]]), "[TABLE]t [SCHEMA]h [ROWS]1|2|3"),
    ((None, None, None, None), "[TABLE]t [SCHEMA]table_id,x [ROWS]9"),
])
def test_sniffed(spark, doc, expected):
    schema = "column_names array<array<string>>, header array<string>, rows array<array<string>>, row_data array<array<string>>"
    df = spark.createDataFrame([doc], schema).withColumn("table_id", F.lit("t")).withColumn(
        "fields", F.create_map(F.lit("table_id"), F.lit("t"), F.lit("x"), F.lit("9"))
    )
    view = views.sniffed_view("table_id", "column_names", "header", "rows", "row_data", "fields")
    assert df.select(view.alias("x")).first().x == expected


def test_names(spark):
    df = spark.createDataFrame([(" My Table, One", " Fk Name ", "a-b.c")], "t string, k string, c string")
    r = df.select(
        names.table_key(F.col("t")).alias("t"), names.fk_key(F.col("k")).alias("k"),
        names.collection_name(F.col("c"), F.lit("x.y")).alias("c"), names.table_key(F.lit("_x")).alias("u"),
    ).first()
    assert (r.t, r.k, r.c, r.u) == ("_my_table_one", "fk_name", "a_b_c_x_y", "_x")


def test_utf8_replacement(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "raw binary")
    assert df.select(names.utf8(F.col("raw")).alias("x")).first().x == "a�b"


def test_ids(spark):
    r = spark.range(1).select(
        hashing.point_id(F.lit("d"), F.lit("t")).alias("p"),
        hashing.content_id(F.lit("d"), F.lit("t"), F.lit("text")).alias("c"), hashing.h("a", "b").alias("h"),
    ).first()
    assert r.p == hashlib.md5(b"d_t").hexdigest()
    assert int(r.c) == int(hashlib.md5(b"d::t::text").hexdigest()[:16], 16)
    assert r.h == int(hashlib.md5(b"a|b").hexdigest()[:15], 16)
