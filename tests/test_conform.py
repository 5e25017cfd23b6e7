"""Declared schemas: casts, defaults and paths of what does not fit."""

from pageloom.plans.conform import RECORD, conformed, field
from pyspark.sql import types as T

TEXT, INT = T.StringType(), T.IntegerType()
SCHEMA = T.StructType([
    field("name", TEXT, required=True), field("size", INT, default=7),
    field("box", T.StructType([
        field("kind", TEXT, literal=["a", "b"], required=True), field("legs", TEXT, union=[INT, T.DoubleType()]),
        field("parts", T.ArrayType(T.StructType([field("n", INT, required=True), field("ok", T.BooleanType(), default=True)])), required=True),
        field("by", T.MapType(TEXT, T.DoubleType())), field("tags", T.ArrayType(TEXT, False)),
    ]), required=True),
])
GIVEN = ("id int, name string, size string, box struct<kind:string,legs:string,parts:array<struct<n:string,ok:string,more:string>>,"
         "by:map<string,string>,tags:array<string>,extra:int>, other int")


def one(spark, *rows):
    return conformed(spark.createDataFrame(list(rows), GIVEN), SCHEMA).orderBy("id").collect()


def test_what_fits_is_read(spark):
    r = one(spark, (1, "x", " 12 ", ("a", "2.5", [("1", "true", "m"), ("2", None, None)], {"k": "1.5"}, ["t"], 3), 9))[0]
    assert r.type_errors == [] and (r.name, r.size, r.other) == ("x", 12, 9)
    assert r.box.asDict(True) == {"kind": "a", "legs": "2.5", "parts": [{"n": 1, "ok": True}, {"n": 2, "ok": True}], "by": {"k": 1.5}, "tags": ["t"]}


def test_errors_name_the_path(spark):
    rows = one(
        spark, (1, None, "many", ("c", "two", [("x", "maybe", None), (None, None, None)], {"k": "no", "m": "2"}, ["t", None], 3), 9),
        (2, "n", None, None, None), (3, "n", None, ("b", None, None, None, None, None), None))
    assert sorted(rows[0].type_errors) == sorted([
        "name is missing", "size is not int", "box.kind is not one of a, b", "box.kind is missing", "box.legs is not int or float",
        "box.parts[0].n is not int", "box.parts[0].ok is not true or false", "box.parts[1].n is missing", "box.by[k] is not float", "box.tags[1] is missing",
    ][:3] + ["box.legs is not int or float", "box.parts[0].n is not int", "box.parts[0].ok is not true or false", "box.parts[1].n is missing",
             "box.by[k] is not float", "box.tags[1] is missing"])
    assert rows[0].box.by == {"k": None, "m": 2.0} and rows[0].box.parts[0].n is None and rows[0].size is None
    assert rows[1].type_errors == ["box is missing"] and rows[1].box is None and rows[1].size == 7
    assert rows[2].type_errors == ["box.parts is missing"] and rows[2].box.kind == "b"


def test_other_kinds_and_absent_columns(spark):
    df = spark.createDataFrame([(1, ["n"], (["a"],))], "id int, name array<string>, box struct<kind:array<string>>")
    r = conformed(df, SCHEMA).first()
    assert r.type_errors == ["name is not text", "box.kind is not text", "box.parts is missing"] and r.size == 7 and r.box.legs is None
    assert conformed(df, SCHEMA, strict=True).count() == 0


def test_records_schema_compiles(spark):
    df = spark.createDataFrame([(1,)], "page_id int")
    assert conformed(df, RECORD).first().type_errors == ["summary_info is missing", "basic_stats is missing"]
