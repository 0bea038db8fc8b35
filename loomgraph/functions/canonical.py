"""Canonical JSON as native expressions: sorted keys, ASCII only, one form for each value, from which ids are made."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from loomgraph.functions.cid import cid

#: The escapes of JSON texts that have a short form.
SHORT = (("\\u000a", "\\n"), ("\\u000d", "\\r"), ("\\u0009", "\\t"), ("\\u0008", "\\b"), ("\\u000c", "\\f"))


def text(c: Column) -> Column:
    """A text in quotes. Other than printable ASCII, code units are written as four hex digits."""

    def part(x: Column) -> Column:
        plain = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        coded = F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
        for long, short in SHORT:
            coded = F.replace(coded, F.lit(long), F.lit(short))
        return F.when(F.rlike(x, F.lit("^[ -~]")), plain).otherwise(coded)

    parts = F.transform(F.regexp_extract_all(c, F.lit("([ -~]+|[^ -~]+)"), F.lit(1)), part)
    return F.concat(F.lit('"'), F.array_join(parts, ""), F.lit('"'))


def bind(c: Column, f) -> Column:
    """f over a column that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def number(c: Column) -> Column:
    """A double as its shortest digits, with an exponent below 1e-4 and from 1e16 on.

    Below 2.3e-308 the digits may not be the shortest, and from 1e16 on about one number in a thousand ends in the
    neighbouring digit; both are read back as the same number.
    """
    # the platform's own digits aren't always the shortest that are read back as the same number
    own = F.abs(c).cast("string")
    tries = [F.format_string("%.14e", F.abs(c)), F.format_string("%.15e", F.abs(c)), F.regexp_replace(own, r"^(\d\.\d{15})\d+", "$1"), F.format_string("%.16e", F.abs(c))]
    raw = F.upper(F.coalesce(*[F.when(t.try_cast("double") == F.abs(c), t) for t in tries], own))

    def parts(r: Column) -> Column:
        mantissa = F.regexp_extract(r, r"^([0-9.]+)", 1)
        shift = F.coalesce(F.regexp_extract(r, r"E([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
        return F.struct(F.regexp_extract(mantissa, r"^(\d+)", 1).alias("whole"), F.regexp_replace(F.regexp_extract(mantissa, r"\.(\d*)$", 1), "0+$", "").alias("fraction"), shift.alias("shift"))

    def scaled(p: Column) -> Column:
        every = F.concat(p["whole"], p["fraction"])
        digits = F.regexp_replace(every, "^0+", "")
        # the value is 0.digits times ten to this power
        point = F.length(p["whole"]) + p["shift"] - (F.length(every) - F.length(digits))
        return F.struct(F.regexp_replace(digits, "0+$", "").alias("digits"), point.alias("point"))

    def shown(d: Column) -> Column:
        digits, point = d["digits"], d["point"]
        size, e = F.length(digits), point - 1
        fixed = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size), F.lit(".0")))
            .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        )
        power = F.abs(e).cast("string")
        rest = F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit(""))
        science = F.concat(F.left(digits, F.lit(1)), rest, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
        return F.when((e >= -4) & (e < 16), fixed).otherwise(science)

    sign = F.when(F.rlike(c.cast("string"), F.lit("^-")), "-").otherwise("")
    found = bind(bind(bind(raw, parts), scaled), shown)
    return F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.concat(sign, F.lit("Infinity"))).when(c == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, found))


def value(c: Column, kind: S.DataType) -> Column:
    """Any value as canonical JSON; null is null.

    Struct and map keys are sorted by code point, items parted by a comma and a space, keys by a colon and a space.
    Texts, booleans, whole numbers, doubles, structs, arrays and maps with text keys; floats count as doubles,
    decimals are written with their digits, dates and times as texts. Other kinds are refused.
    """
    if isinstance(kind, (S.StringType, S.DateType, S.TimestampType, S.TimestampNTZType)):
        out = text(c.cast("string"))
    elif isinstance(kind, S.BooleanType):
        out = F.when(c, "true").otherwise("false")
    elif isinstance(kind, (S.ByteType, S.ShortType, S.IntegerType, S.LongType, S.DecimalType)):
        out = c.cast("string")
    elif isinstance(kind, (S.FloatType, S.DoubleType)):
        out = number(c.cast("double"))
    elif isinstance(kind, S.StructType):
        pairs = [F.concat(F.lit(json.dumps(f.name) + ": "), value(c.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    elif isinstance(kind, S.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: value(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, S.MapType) and isinstance(kind.keyType, S.StringType):
        pair = lambda e: F.concat(text(e["key"]), F.lit(": "), value(e["value"], kind.valueType))
        by_key = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k.alias("key"), F.element_at(c, k).alias("value")))
        out = F.concat(F.lit("{"), F.array_join(F.transform(by_key, pair), ", "), F.lit("}"))
    else:
        raise TypeError(f"no JSON form of {kind.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(out)


def row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Some columns of a row (all, if none are named) as one object."""
    names = columns if columns is not None else df.columns
    pairs = [F.concat(F.lit(json.dumps(n) + ": "), value(F.col(f"`{n}`"), df.schema[n].dataType)) for n in sorted(names)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def with_cid(df: DataFrame, columns: list[str] | None = None, name: str = "cid") -> DataFrame:
    """Adds the content id of a row's canonical JSON."""
    return df.withColumn(name, cid(row(df, columns)))
