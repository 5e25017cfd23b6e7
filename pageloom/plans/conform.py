"""Records under a declared schema: casts, defaults and what is wrong, by path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.text import strip
from pageloom.schema import STAT_TYPES

NAMES = {"int": "int", "bigint": "int", "double": "float", "float": "float", "string": "text", "boolean": "true or false"}


def field(name: str, kind: T.DataType, default=None, literal: Sequence[str] | None = None,
          union: Sequence[T.DataType] | None = None, required: bool = False) -> T.StructField:
    """One field of a declared schema.

    ``default`` stands for a value that is not there, ``literal`` lists the values allowed, ``union`` the types that a text may
    be read as (the field stays text); a ``required`` field has no default and must be there.
    """
    more = {"default": default, "literal": list(literal) if literal else None, "union": [t.simpleString() for t in union] if union else None}
    return T.StructField(name, kind, not required, {k: v for k, v in more.items() if v is not None})


def _found(*messages: Column) -> Column:
    return F.array_compact(F.array(*messages)).cast("array<string>")


def _nothing() -> Column:
    return F.array().cast("array<string>")


def compiled(value: Column, given: T.DataType | None, wanted: T.DataType, path: Column, meta: dict | None = None) -> tuple[Column, Column]:
    """(``value`` as ``wanted``, array of what does not fit) for a value of the type ``given``; None where it is not there at all.

    Structs, arrays and maps are gone through field by field and entry by entry; ``path`` names the place.  A part that
    does not fit is null, the rest stays.  A list or record given where another kind is declared does not fit as a whole.
    """
    meta = meta or {}
    if given is None:
        return _default(wanted, meta), _nothing()
    whole = {T.StructType, T.ArrayType, T.MapType}
    if type(wanted) in whole or type(given) in whole:
        if type(wanted) is not type(given):
            wrong = F.concat(path, F.lit(f" is not {_name(wanted)}"))
            return F.lit(None).cast(wanted), _found(F.when(value.isNotNull(), wrong))
        return _nested(value, given, wanted, path)
    if meta.get("union"):
        kinds = meta["union"]
        fits = F.lit(False)
        for kind in kinds:
            fits = fits | (F.lit(True) if kind == "string" else strip(value.cast("string")).try_cast(kind).isNotNull())
        typed = F.when(fits, value.cast("string"))
        what = " or ".join(NAMES.get(k, k) for k in kinds)
    elif isinstance(wanted, T.StringType):
        typed, what = value.cast("string"), "text"
    else:
        typed, what = strip(value.cast("string")).try_cast(wanted), _name(wanted)
    if meta.get("literal"):
        typed = F.when(typed.cast("string").isin(*meta["literal"]), typed)
        what = "one of " + ", ".join(meta["literal"])
    wrong = F.when(value.isNotNull() & typed.isNull(), F.concat(path, F.lit(f" is not {what}")))
    if "default" in meta:
        typed = F.when(value.isNull(), F.lit(meta["default"]).cast(wanted)).otherwise(typed)
    return typed, _found(wrong)


def _name(kind: T.DataType) -> str:
    nested = {"struct": "a record", "array": "a list", "map": "a map"}
    return nested.get(kind.typeName()) or NAMES.get(kind.simpleString(), kind.simpleString())


def _default(wanted: T.DataType, meta: dict) -> Column:
    return F.lit(meta.get("default")).cast(wanted)


def _nested(value: Column, given: T.DataType, wanted: T.DataType, path: Column) -> tuple[Column, Column]:
    there = lambda errors: F.when(value.isNotNull(), errors).otherwise(_nothing())
    if isinstance(wanted, T.ArrayType):
        part = lambda x, i: compiled(x, given.elementType, wanted.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        missing = lambda x, i: _found(F.when(x.isNull(), F.concat(path, F.lit("["), i.cast("string"), F.lit("] is missing"))))
        errors = lambda x, i: F.concat(part(x, i)[1], missing(x, i) if not wanted.containsNull else _nothing())
        return F.transform(value, lambda x, i: part(x, i)[0]), there(F.flatten(F.transform(value, errors)))
    if isinstance(wanted, T.MapType):
        part = lambda k, v: compiled(v, given.valueType, wanted.valueType, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")))
        entries = F.map_entries(value)
        typed = F.transform_values(value, lambda k, v: part(k, v)[0])
        return typed, there(F.flatten(F.transform(entries, lambda e: part(e["key"], e["value"])[1])))
    known = {f.name: f.dataType for f in given.fields}
    parts, errors = [], []
    for f in wanted.fields:
        inner = F.concat(path, F.lit(f".{f.name}"))
        own = value[f.name] if f.name in known else None
        typed, wrong = compiled(own, known.get(f.name), f.dataType, inner, f.metadata)
        parts.append(typed.alias(f.name))
        errors.append(wrong)
        if not f.nullable:
            gone = F.lit(True) if own is None else own.isNull()
            errors.append(_found(F.when(gone, F.concat(inner, F.lit(" is missing")))))
    return F.when(value.isNotNull(), F.struct(*parts)), there(F.concat(*errors))


def conformed(records: DataFrame, schema: T.StructType, errors: str = "type_errors", strict: bool = False) -> DataFrame:
    """``records`` with the columns of ``schema`` under their declared types; other columns stay as they are.

    The schema, built with ``field``, is compiled once into column expressions: numbers in text are read, values outside a
    literal and parts of another kind become null, defaults stand for what is not there, and fields that are not declared are dropped from
    records.  ``errors`` lists what does not fit or is required and missing, each with its path, as ``a.b[2].c``; with
    ``strict`` only records without any remain.
    """
    given = {f.name: f.dataType for f in records.schema.fields}
    columns, found = {}, []
    for f in schema.fields:
        own = F.col(f.name) if f.name in given else None
        typed, wrong = compiled(own, given.get(f.name), f.dataType, F.lit(f.name), f.metadata)
        columns[f.name] = typed
        found.append(wrong)
        if not f.nullable:
            found.append(_found(F.when(F.lit(True) if own is None else own.isNull(), F.lit(f"{f.name} is missing"))))
    out = records.withColumns({errors: F.concat(*found), **{f"_typed_{n}": c for n, c in columns.items()}})
    out = out.drop(*columns).withColumnsRenamed({f"_typed_{n}": n for n in columns})
    return out.where(F.size(errors) == 0) if strict else out


_TEXT = T.StringType()


def _texts() -> T.ArrayType:
    return T.ArrayType(_TEXT, False)


#: What an extracted record must hold.
RECORD = T.StructType([
    field("summary_info", T.StructType([
        field("roles", _texts(), required=True), field("complexity", _TEXT), field("adjectives", _texts(), required=True),
        field("num_legs", _TEXT, union=[_TEXT, T.IntegerType()], required=True), field("abilities", _texts()),
        field("summary", _TEXT, required=True),
    ]), required=True),
    field("basic_stats", T.StructType([
        field("attributes", T.ArrayType(T.StructType([
            field("attribute", _TEXT, required=True), field("type", _TEXT, literal=["primary", "secondary"], required=True),
            field("base_attribute", _TEXT, required=True), field("attribute_gain", _TEXT, required=True),
        ]))),
        *[field(name, {"int": T.IntegerType(), "double": T.DoubleType(), "string": _TEXT}[kind]) for name, kind in STAT_TYPES.items()],
    ]), required=True),
])
