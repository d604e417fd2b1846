"""JSON from rows and arguments: typed by operator, placed by name or pointer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsontext import json_of, json_text, number_text
from ..functions.text import let
from ..sources.readers import json_refusal
from .shape import Shape

#: Limits of a built document.
MOST_DEPTH, MOST_VALUES = 1000, 4_194_304
#: Bytes of a file whose text becomes a member.
MOST_FILE = 1 << 20


class UsageError(ValueError):
    """Arguments that contradict each other; raised before anything is read."""


def pointer(path: str) -> list[str]:
    """Steps of an RFC 6901 pointer."""
    if path and not path.startswith("/"):
        raise UsageError(f"{path}: a pointer begins with /")
    steps = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
    if len(steps) > MOST_DEPTH:
        raise UsageError(f"{path[:40]}: over {MOST_DEPTH} steps")
    return steps


class Node(dict):
    """An object or a list under construction."""

    def __init__(self, is_list: bool = False):
        super().__init__()
        self.is_list = is_list


def _put(root: Node, steps: Sequence[str], value: Column, whole: str) -> None:
    at = root
    for k, step in enumerate(steps):
        last = k == len(steps) - 1
        if at.is_list:
            if step != "-" and not (step.isdigit() and int(step) < len(at)):
                raise UsageError(f"{whole}: the list has no place {step}")
            step = str(len(at)) if step == "-" else step
        if last:
            if step in at:
                raise UsageError(f"{whole}: given twice")
            at[step] = value
        else:
            following = at.setdefault(step, Node(steps[k + 1] == "-"))
            if not isinstance(following, Node):
                raise UsageError(f"{whole}: holds a value already")
            at = following


def listed(*values: Column) -> Column:
    """A JSON array of values that are JSON already."""
    return F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")) if values else F.lit("[]")


def _rendered(node: Node) -> Column:
    parts = []
    for key, value in node.items():
        body = _rendered(value) if isinstance(value, Node) else value
        parts.append(body if node.is_list else F.concat(json_text(F.lit(key)), F.lit(":"), body))
    marks = "[]" if node.is_list else "{}"
    return F.concat(F.lit(marks[0]), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit(marks[1]))


def built(*members: tuple[str, str, Column]) -> Column:
    """A JSON text column from (operator, key, value) members, in their order.

    ``=`` takes the value as a string, ``:=`` as JSON already, ``[]=`` adds a
    string to a list, and ``path`` and ``path:=`` place a string or JSON by pointer.
    """
    if len(members) > MOST_VALUES:
        raise UsageError(f"over {MOST_VALUES} values")
    root = Node()
    for operator, key, value in members:
        body = value if operator.endswith(":=") else json_text(value)
        if operator in ("=", ":="):
            _put(root, [key], body, key)
        elif operator == "[]=":
            own = root.setdefault(key, Node(True))
            if not isinstance(own, Node) or not own.is_list:
                raise UsageError(f"{key}: a value and a list")
            own[str(len(own))] = body
        elif operator in ("path", "path:="):
            _put(root, pointer(key), body, key)
        else:
            raise UsageError(f"{operator}: no such operator")
    return _rendered(root)


def array_built(*values: tuple[str, Column]) -> Column:
    """A JSON list from (operator, value): ``=`` takes a string, ``:=`` JSON."""
    if unknown := [o for o, _ in values if o not in ("=", ":=")]:
        raise UsageError(f"{', '.join(unknown)}: no operator for a list's values")
    if len(values) > MOST_VALUES:
        raise UsageError(f"over {MOST_VALUES} values")
    return listed(*[v if o == ":=" else json_text(v) for o, v in values])


def file_text(spark: SparkSession, path: str, *, as_json: bool = False) -> Column:
    """A file's text as a value, its line ends kept; for ``:=`` it must be one JSON
    value. The file is a plan's constant, so it is of at most 1 MiB."""
    length = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if length is None or length > MOST_FILE:
        raise UsageError(f"{path}: no file of at most {MOST_FILE} bytes")
    whole = spark.read.text(path, wholetext=True)
    valid = F.is_valid_utf8("value")
    row = whole.select("value", valid.alias("valid"), (json_refusal(F.col("value")) if as_json else F.lit(None)).alias("why")).first()
    text, good, why = row if row else ("", True, "not JSON" if as_json else None)
    if not good or why:
        raise UsageError(f"{path}: {why or 'not UTF-8'}")
    return F.lit(text.strip(" \t\r\n") if as_json else text)


def each(df: DataFrame, *members: tuple[str, str, Column]) -> DataFrame:
    """``df`` with document: one JSON text for each row."""
    return df.withColumn("document", built(*members))


def extracted(df: DataFrame, keys: Sequence[str], *, keep: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Only these keys; one that the rows don't have is a usage error."""
    if unknown := [k for k in keys if k not in df.columns]:
        raise UsageError(f"no key {', '.join(unknown)}; there are {', '.join(df.columns)}")
    return df.select(*[c for c in keep if c in df.columns], *keys)


def excluded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All but these keys; one that the rows don't have is a usage error."""
    if unknown := [k for k in keys if k not in df.columns]:
        raise UsageError(f"no key {', '.join(unknown)}; there are {', '.join(df.columns)}")
    return df.drop(*keys)


def read_only(shape: Shape, captures: DataFrame, *, extract: Sequence[str] = (), exclude: Sequence[str] = (), mode: str = "fail") -> DataFrame:
    """A shape's rows (a composite's or records' documents) with only some keys,
    or without some. A document's keys are its parts. Keys that the shape doesn't
    have are a usage error, raised from its schema before any text is read."""
    if extract and exclude:
        raise UsageError("keys to extract, or keys to exclude, not both")
    parted = bool(shape.parts)
    rows = shape.documents(captures, mode) if parted else shape.read(captures, mode)
    if not extract and not exclude:
        return rows
    kept = [c for c in ("capture_id", "record", "num", "refusal") if c in rows.columns]
    keys = list(shape.parts) if parted else [c for c in rows.columns if c not in kept]
    if unknown := [k for k in (*extract, *exclude) if k not in keys]:
        raise UsageError(f"no key {', '.join(unknown)}; there are {', '.join(keys)}")
    return rows.select(*kept, *(extract or [k for k in keys if k not in exclude]))


def encoded(df: DataFrame, omittable: Sequence[str] = (), *, indent: str = "") -> DataFrame:
    """(json): each row as one JSON object in the columns' order, on one line or,
    with an ``indent``, each member on its own. A null is written as null, also
    within lists and objects, or left out where its key may be; a map's keys
    stand in its order."""
    row = F.struct(*[F.col(f"`{n}`") for n in df.columns])
    return df.select(json_of(row, df.schema, indent, 0, omittable).alias("json"))
