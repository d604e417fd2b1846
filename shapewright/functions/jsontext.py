"""Values as JSON text, by built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let


def json_text(value: Column) -> Column:
    """A string as JSON, without escapes that HTML would need; U+2028 and U+2029
    are escaped, as scripts take them for line ends."""
    text = F.to_json(F.array(value))
    text = F.replace(F.replace(text, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def number_text(value: Column) -> Column:
    """A double as the shortest JSON number: no ``.0``, exponents from 1e21 and below 1e-6.
    Subnormal numbers may have more digits than they need."""
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"\.?0+\z", "")
    size = F.abs(value)
    exact = F.when((size >= 1e-6) & (size < 1e15) & (value.cast("decimal(38,18)").cast("double") == value), plain)
    # the fewest digits that give the value back, of 15, 16 and 17
    forms = [F.format_string(f"%.{k}e", value) for k in (14, 15, 16)]
    fewest = F.coalesce(*[F.when(f.cast("double") == value, f) for f in forms])

    def spelled(form: Column) -> Column:
        sign, power = F.regexp_extract(form, r"\A(-?)", 1), F.regexp_extract(form, r"e\+?(-?[0-9]+)\z", 1).cast("int")
        digits = F.regexp_replace(F.regexp_replace(form, r"\A-|\.|e.*\z", ""), r"(?<=[0-9])0+\z", "")
        n = F.length(digits)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        large = F.concat(digits, F.repeat(F.lit("0"), power + 1 - n))
        middle = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n))
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        apart = F.concat(F.substring(digits, 1, 1), tail, F.when(power < 0, "e").otherwise("e+"), power.cast("string"))
        return F.concat(sign, F.when((size < 1e-6) | (size >= 1e21), apart).when(power < 0, small).when(n <= power + 1, large).otherwise(middle))

    return F.when(value == 0, "0").otherwise(F.coalesce(exact, let(fewest, spelled)))


def _framed(marks: str, parts: Column, indent: str, depth: int) -> Column:
    """Members in brackets, each on a line of its own if there is an indent."""
    if not indent:
        return F.concat(F.lit(marks[0]), F.array_join(parts, ","), F.lit(marks[1]))
    inner, outer = "\n" + indent * (depth + 1), "\n" + indent * depth
    full = F.concat(F.lit(marks[0] + inner), F.array_join(parts, "," + inner), F.lit(outer + marks[1]))
    return F.when(F.size(parts) == 0, marks).otherwise(full)


def json_of(c: Column, kind: T.DataType, indent: str, depth: int, omittable: Sequence[str] = ()) -> Column:
    """A value as JSON text by its type; a null is ``null`` wherever it stands."""
    colon = ": " if indent else ":"
    if isinstance(kind, T.StructType):

        def member(f: T.StructField) -> Column:
            own = json_of(c[f.name], f.dataType, indent, depth + 1)
            if f.name in omittable:
                own = F.when(c[f.name].isNotNull(), own)
            return F.concat(json_text(F.lit(f.name)), F.lit(colon), own)

        body = _framed("{}", F.array_compact(F.array(*[member(f) for f in kind.fields])), indent, depth)
    elif isinstance(kind, T.ArrayType):
        body = _framed("[]", F.transform(c, lambda x: json_of(x, kind.elementType, indent, depth + 1)), indent, depth)
    elif isinstance(kind, T.MapType):
        body = _framed("{}", F.transform(F.map_entries(c), lambda e: F.concat(json_text(e["key"].cast("string")), F.lit(colon), json_of(e["value"], kind.valueType, indent, depth + 1))), indent, depth)
    elif isinstance(kind, T.VariantType):
        body = F.to_json(c)
    elif isinstance(kind, T.StringType):
        body = json_text(c)
    elif isinstance(kind, T.DoubleType):
        body = number_text(c)
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        body = c.cast("string")
    else:
        body = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1)
    return F.when(c.isNull(), "null").otherwise(body)
