"""Tables cut at display columns, and drawn tables.

Display width can't be told by built-in functions, so the cut is a small helper
over Arrow batches; captures are spread over tasks as they come, and nothing
is gathered.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import Field
from ..functions.text import let, normal_name
from .lines import blocks, indexes
from .parse import LineReader, alike, cells_reader, map_reader, named_cells, same_heading
from .workers import reach_workers


def width(text: str) -> int:
    """Terminal columns of a text: none for marks and controls, two for wide ones."""
    if text.isascii() and text.isprintable():
        return len(text)
    total = 0
    for c in text:
        if unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc"):
            continue
        total += 2 if unicodedata.east_asian_width(c) in "WF" else 1
    return total


def column_starts(header: str, count: int) -> list[int] | None:
    """Display columns at which ``count`` headings begin; headings of several
    words are told by gaps of two spaces, where words alone are too many."""
    starts, at, gap = [], 0, 2
    words: list[tuple[int, int]] = []
    for c in header:
        if c != " ":
            if gap:
                words.append((at, gap))
            gap = 0
        else:
            gap += 1
        at += width(c)
    starts = [s for s, _ in words]
    if len(starts) > count:
        starts = [s for s, g in words if g >= 2]
    return starts if len(starts) == count else None


def cut(line: str, starts: Sequence[int]) -> list[str] | None:
    """Cells of a line at the columns. A boundary inside a word moves left to a
    space; None where a cell runs into the next column, or holds a gap."""
    plain = line.isascii() and line.isprintable()  # then a character is a column
    places = [] if plain else [0, *accumulate(width(c) for c in line)]
    edges: list[int] = []
    for start in starts:
        k = min(start, len(line)) if plain else min(bisect_left(places, start), len(line))
        back = k
        while 0 < back < len(line) and line[back - 1] != " ":
            back -= 1
        if edges and back <= edges[-1] and k < len(line) and start:
            return None
        edges.append(back if start else 0)
    edges.append(len(line))
    cells = [line[a:b].strip() for a, b in zip(edges, edges[1:], strict=False)]
    if any("   " in c for c in cells[:-1]):
        return None
    return cells


def heading_starts(header: str) -> tuple[list[int], list[str]]:
    """Display columns at which headings begin, and the headings: told apart by
    gaps of two spaces, or, where there is no such gap, by single ones."""
    text = header.expandtabs(8)
    wide = re.compile(r"\S+(?: \S+)*") if "  " in text.strip() else re.compile(r"\S+")
    found = list(wide.finditer(text))
    return [width(text[: m.start()]) for m in found], [m.group() for m in found]


def _tables(lines: Column) -> Column:
    """(num, text, header) of the lines of one table or several: a line with the
    words of the first heads a table of its own, at whose columns what follows is cut."""
    same = same_heading(None)

    def cut(all_: Column) -> Column:
        first = same(F.get(all_, F.lit(0))["text"])
        starts = let(first, lambda h: indexes(all_, lambda t: same(t) == h))
        under = lambda b: let(F.get(b, F.lit(0))["text"], lambda h: F.transform(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), lambda v: F.struct(v["num"].alias("num"), v["text"].alias("text"), h.alias("header"))))
        return F.flatten(F.transform(blocks(all_, starts), under))

    return let(lines, cut)


def aligned_cells(columns: Sequence[str] | None, rename: Mapping[str, str] | None = None, leading_label: str = "") -> Callable[[Column], Column]:
    """From an array of (num, text, header) to one of (names, cells); cells are null
    where a line doesn't fit. A column that no heading names begins at the left edge,
    and a header that begins there too leaves it no room."""

    def headed(head: str) -> tuple[list[int] | None, list[str]]:
        room = [0] if leading_label else []
        if columns is not None:
            starts = column_starts(head, len(columns) - len(room))
            names = list(columns)
        else:
            starts, names = heading_starts(head)
            names = [*([leading_label] if leading_label else []), *map(normal_name, names)]
            names = [(rename or {}).get(n, n) for n in names]
        if not starts or (room and starts[0] == 0):
            return None, names
        return [*room, *starts], names

    kind = pa.struct([("names", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))])

    @F.arrow_udf("array<struct<names:array<string>,cells:array<string>>>")
    def read(lines: pa.Array) -> pa.Array:
        known: dict[str, tuple[list[int] | None, list[str]]] = {}
        out = []
        for each in lines.to_pylist():
            told = []
            for v in each or []:
                if v["header"] not in known:
                    known[v["header"]] = headed(v["header"].expandtabs(8))
                starts, names = known[v["header"]]
                told.append({"names": names, "cells": cut(v["text"].expandtabs(8), starts) if starts else None})
            out.append(None if each is None else told)
        return pa.array(out, pa.list_(kind))

    return read


def _unfit(cells: Column, text: Column) -> Column:
    return F.when(cells.isNull(), F.concat(F.lit("not aligned: "), text))


def _cut_rows(captures: DataFrame, read: Callable[[Column], Column]) -> DataFrame:
    """Lines of aligned tables with names and cells, and trouble."""
    reach_workers(captures.sparkSession)
    df = captures.withColumn("lines", _tables(F.col("lines")))
    df = df.withColumn("lines", F.zip_with("lines", read(F.col("lines")), lambda v, r: F.struct(v["num"].alias("num"), v["text"].alias("text"), r["names"].alias("names"), r["cells"].alias("cells"))))
    refusal = F.col("refusal") if "refusal" in captures.columns else F.lit(None).cast("string")
    one = F.array(F.struct(F.lit(0).alias("num"), F.lit("").alias("text"), F.array().cast("array<string>").alias("names"), F.lit(None).cast("array<string>").alias("cells")))
    return df.select("capture_id", refusal.alias("trouble"), F.inline(F.when(refusal.isNotNull(), one).otherwise(F.col("lines"))))


def aligned_derived(captures: DataFrame, rules: Mapping[str, Field] | None = None, *, rename: Mapping[str, str] | None = None, leading_label: str = "", raw: bool = False) -> DataFrame:
    """Rows of tables whose first line heads the columns and names the keys: each
    row is a map, and keys that have a rule are typed columns beside it. Headings
    that are empty or alike refuse their table, lines that don't fit themselves;
    a line that repeats the heading begins another table."""
    df = _cut_rows(captures, aligned_cells(None, rename, leading_label))
    df = df.withColumn("trouble", F.coalesce("trouble", alike(F.col("names")), _unfit(F.col("cells"), F.col("text")))).withColumn("unfit", F.lit(None).cast("string"))
    return named_cells(rules, raw).rows_of(df, ("names", "cells", "trouble", "unfit"))


def aligned_rows(captures: DataFrame, columns: Sequence[str], rules: Mapping[str, Field] | None = None, *, leading_label: str = "", raw: bool = False) -> DataFrame:
    """Rows of tables whose first line heads the columns; keys as given. Empty
    cells are empty texts, and lines that don't fit are refused; a line that
    repeats the heading begins another table."""
    df = _cut_rows(captures, aligned_cells(columns, leading_label=leading_label))
    return cells_reader(columns, rules, raw).rows(df, ("capture_id", "num"), "cells")


def aligned_value(lines: Column, columns: Sequence[str] | None, rules: Mapping[str, Field], *, rename: Mapping[str, str] | None = None, leading_label: str = "", raw: bool = False) -> tuple[Column, LineReader, Callable[[Column], Column]]:
    """The lines of an array of them, each under its header; what reads a line, and what cuts all."""
    return _tables(lines), named_cells(rules, raw) if columns is None else cells_reader(columns, rules, raw), aligned_cells(columns, rename, leading_label)


def box_table(lines: Sequence[str]) -> list[dict[str, str]]:
    """Rows of one drawn table: rules are lines of drawing marks, the first
    group of bar lines is the header, and a bar line with an empty first cell
    continues the row above. Raises ValueError if the text isn't such a table."""
    bars, marks = "|│┃║", set("+-=|:─━═┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬┏┓┗┛┣┫┳┻╋╭╮╰╯│┃║╞╡╪╒╕╘╛ ")
    groups: list[list[list[str]]] = [[]]
    for line in lines:
        text = line.strip()
        if set(text) <= marks and any(c in "-=─━═" for c in text):
            groups.append([])
            continue
        bar = next((b for b in bars if b in text), None)
        if bar is None:
            raise ValueError(f"neither a rule nor a row: {line}")
        groups[-1].append([c.strip() for c in text.strip(bar).split(bar)])
    groups = [g for g in groups if g]
    if len(groups) < 1 or len([None for line in lines if set(line.strip()) <= marks]) < 1:
        raise ValueError("no rule under a header")
    heads = ["_".join(filter(None, c)) for c in zip(*groups[0], strict=True)]
    names = [normal_name(h) for h in heads]
    if "" in names or len(set(names)) < len(names):
        raise ValueError("headings that are empty or alike")
    rows: list[list[str]] = []
    for group in groups[1:]:
        for k, cells in enumerate(group):
            if len(cells) != len(names):
                raise ValueError("a row of another length")
            if not cells[0] and k:
                rows[-1] = ["\n".join(filter(None, pair)) for pair in zip(rows[-1], cells, strict=True)]
            else:
                rows.append(cells)
    return [dict(zip(names, r, strict=True)) for r in rows]


def _drawn(texts: pa.Array) -> pa.Array:
    out = []
    for each in texts.to_pylist():
        try:
            out.append(None if each is None else {"rows": [list(r.items()) for r in box_table(each)], "refusal": None})
        except ValueError as e:
            out.append({"rows": None, "refusal": str(e)})
    return pa.array(out, pa.struct([("rows", pa.list_(pa.map_(pa.string(), pa.string()))), ("refusal", pa.string())]))


def box_cells(lines: Column) -> Column:
    """(rows, refusal) of an array of lines: a map of each row, by the headings."""
    read = F.arrow_udf(_drawn, "struct<rows:array<map<string,string>>,refusal:string>")
    return read(F.transform(lines, lambda v: v["text"]))


def box_rows(captures: DataFrame, rules: Mapping[str, Field] | None = None, *, raw: bool = False) -> DataFrame:
    """(capture_id, row, cells, refusal) of drawn tables; the keys are the
    headings, so cells is a map. Keys that have a rule are typed columns beside it."""
    reach_workers(captures.sparkSession)
    refusal = F.col("refusal") if "refusal" in captures.columns else F.lit(None).cast("string")
    df = captures.select("capture_id", refusal.alias("trouble"), "lines").withColumn("read", box_cells(F.col("lines")))
    df = df.withColumn("trouble", F.coalesce("trouble", "read.refusal"))
    none = F.array(F.lit(None).cast("map<string,string>"))
    df = df.select("capture_id", "trouble", F.posexplode(F.when(F.col("trouble").isNotNull(), none).otherwise(F.col("read.rows"))).alias("row", "cells"))
    df = df.withColumn("row", F.when(F.col("trouble").isNull(), F.col("row") + 1).otherwise(0)).withColumn("unfit", F.lit(None).cast("string"))
    return map_reader(rules, raw).rows_of(df, ("cells", "trouble", "unfit"), ("capture_id", "row"))
