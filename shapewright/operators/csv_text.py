"""Strict CSV: quotes that open at a value's start, short and long rows told.

Files whose rows are known to be rectangular are read by Spark's own reader
(``sources.rectangular_csv``). This reads captures by the stricter rules; each
is at most 64 MiB, and a generator hands over one record at a time.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import Field, compiled
from ..functions.steps import held
from .lines import MOST_BYTES
from .workers import reach_workers


def records(text: str, delimiter: str = ",") -> Iterator[tuple[int, list[str]]]:
    """(line, values) of each record. ValueError for an open quote, text after
    a closing one, or a carriage return outside quotes."""
    at, line, size = 0, 1, len(text)
    while at < size:
        values, begun = [], line
        while True:
            if at < size and text[at] == '"':
                value = ""
                at += 1
                while True:
                    end = text.find('"', at)
                    if end < 0:
                        raise ValueError(f"a quote that line {begun} opens isn't closed")
                    value += text[at:end]
                    at = end + 1
                    if text.startswith('"', at):
                        value += '"'
                        at += 1
                    else:
                        break
                line += value.count("\n")
                if at < size and not text.startswith((delimiter, "\n", "\r\n"), at):
                    raise ValueError(f"text after a quote at line {line}")
            else:
                ends = [e for e in (text.find(delimiter, at), text.find("\n", at)) if e >= 0]
                end = min(ends, default=size)
                value = text[at:end]
                at = end
                if (end == size or text[end] == "\n") and value.endswith("\r"):
                    value = value[:-1]
                if "\r" in value:
                    raise ValueError(f"a carriage return at line {line}")
            values.append(value)
            if text.startswith(delimiter, at):
                at += len(delimiter)
                continue
            at += 2 if text.startswith("\r\n", at) else 1
            line += 1
            break
        yield begun, values


def quote_open(text: str, delimiter: str = ",", inside: bool = False) -> bool:
    """Whether a quote that opened at a value's start is open at a line's end;
    ``inside`` if one is at its start. Each line is read once."""
    at = 0
    while True:
        if inside or text.startswith('"', at):
            at += not inside
            inside = False
            while (end := text.find('"', at)) >= 0 and text.startswith('"', end + 1):
                at = end + 2
            if end < 0:
                return True
            at = end + 1
        following = text.find(delimiter, at)
        if following < 0:
            return False
        at = following + len(delimiter)


def named(heads: list[str]) -> list[str]:
    """Names told apart: the second ``x`` is ``x_2``; an empty one is its column."""
    out: list[str] = []
    for k, h in enumerate(heads, 1):
        name, n = h or f"column_{k}", 1
        while name in out:
            n += 1
            name = f"{h or f'column_{k}'}_{n}"
        out.append(name)
    return out


def quick_records(text: str, delimiter: str = ",") -> Iterator[tuple[int, list[str]]]:
    """The same records, by the standard reader, which is told to be strict; the
    characters that it takes another way go to ``records``."""
    if "\r" in text or "\0" in text or len(delimiter) != 1 or (delimiter != "," and delimiter in '"\n '):
        yield from records(text, delimiter)
        return
    if '"' not in text:
        parts = text.split("\n")
        if not parts[-1]:
            parts.pop()
        for k, line in enumerate(parts, 1):
            yield k, line.split(delimiter)
        return
    csv.field_size_limit(MOST_BYTES)
    reader = csv.reader(io.StringIO(text, newline="\n"), delimiter=delimiter, strict=True)
    begun = 1
    try:
        for values in reader:
            yield begun, values or [""]
            begun = reader.line_num + 1
    except csv.Error as e:
        raise ValueError(f"line {begun}: {e}") from e


def _plain_block(text: str, delimiter: str, names: list[str], begun: int) -> tuple[np.ndarray, pa.Array, int] | None:
    """Numbers and cells of the lines of a text without a quote or carriage return
    whose lines all have a cell for each name; None if it isn't such a text."""
    lines = text.count("\n") + (not text.endswith("\n"))
    if text.count(delimiter) != lines * (len(names) - 1) or text.startswith("\n") or "\n\n" in text:
        return None
    body = pa.array([text.removesuffix("\n")])
    cut = pc.split_pattern(body, "\n").flatten()
    cells = pc.split_pattern(cut, delimiter)
    if len(names) > 1 and not pc.all(pc.equal(pc.list_value_length(cells), len(names))).as_py():
        return None
    return np.arange(begun, begun + len(cut), dtype=np.int32), cells.flatten(), len(cut)


def _read_csv(text: str | None, delimiter: str, header: bool, columns: Sequence[str], asked: set[str]) -> tuple[list[str], np.ndarray, pa.Array]:
    """(names, numbers of records, their cells, one after another) of a whole text. ValueError tells why it is refused."""
    if text is None:
        raise ValueError("no text")
    text = text.removeprefix("\ufeff")
    names: list[str] | None = list(columns) or None
    heads = header and not names
    if '"' not in text and "\r" not in text and len(delimiter) == 1 and delimiter not in "\n ":
        head, _, rest = text.partition("\n")
        if head:
            own = names or (named(head.split(delimiter)) if heads else [f"column_{k}" for k in range(1, head.count(delimiter) + 2)])
            if asked <= set(own):
                body, begun = (rest, 2) if heads else (text, 1)
                if not body:
                    return own, np.zeros(0, np.int32), pa.array([], pa.string())
                if found := _plain_block(body, delimiter, own, begun):
                    return own, found[0], found[1]
    nums, cells, done = [], [], []
    for num, values in quick_records(text, delimiter):
        if values == [""]:
            continue
        if names is None:
            names = named(values) if heads else [f"column_{k}" for k in range(1, len(values) + 1)]
            if lacking := sorted(asked - set(names)):
                raise ValueError(f"no column {', '.join(lacking)}; there are {', '.join(names)}")
            if heads:
                continue
        if len(values) > len(names):
            raise ValueError(f"line {num} has {len(values)} values for {len(names)} columns")
        nums.append(num)
        cells += values if len(values) == len(names) else [*values, *[None] * (len(names) - len(values))]
        if len(cells) >= 1 << 16:
            done.append(pa.array(cells, pa.string()))
            cells = []
    return names or [], np.array(nums, np.int32), pa.concat_arrays([*done, pa.array(cells, pa.string())])


def csv_rows(captures: DataFrame, delimiter: str = ",", *, header: bool = True, columns: Sequence[str] = (), rules: Mapping[str, Field] | None = None) -> DataFrame:
    """(capture_id, num, cells, refusal): a map of each record. Short rows end in
    nulls; longer ones than the header are refused. Blank lines are left out.

    Names are the first record's where ``header``, or ``columns``; otherwise they
    are numbered. A column with a rule is a typed column beside the map (an empty
    cell is null there); a rule for a column that a file lacks refuses the file.

    Captures without quotes are cut by Arrow's kernels, many of like names at a
    time; others record by record. A refused capture gives its reason alone.
    """
    asked = set(rules or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[np.ndarray] = []
            nums: list[np.ndarray] = []
            names_: list[pa.Array] = []
            cells_: list[pa.Array] = []
            sizes: list[np.ndarray] = []
            why: list[pa.Array] = []
            waiting = 0

            def made() -> pa.RecordBatch:
                size = np.concatenate(sizes)
                ends = np.concatenate([[0], np.cumsum(np.maximum(size, 0))]).astype(np.int32)
                offsets = pa.array(ends, mask=np.append(size < 0, False)) if (size < 0).any() else pa.array(ends)
                cells = pa.MapArray.from_arrays(offsets, pa.concat_arrays(names_), pa.concat_arrays(cells_))
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(nums)), cells, pa.concat_arrays(why)], names=["capture_id", "num", "cells", "refusal"])

            for at, text in enumerate(batch.column(1)):
                try:
                    if (trouble := batch.column(2)[at].as_py()) is not None:
                        raise ValueError(trouble)
                    names, own, cells = _read_csv(text.as_py(), delimiter, header, columns, asked)
                except ValueError as e:
                    rows.append(np.array([at]))
                    nums.append(np.zeros(1, np.int32))
                    sizes.append(np.array([-1]))
                    why.append(pa.array([str(e)], pa.string()))
                    continue
                for a in range(0, len(own), 10_000):
                    n = min(10_000, len(own) - a)
                    rows.append(np.full(n, at))
                    nums.append(own[a : a + n])
                    sizes.append(np.full(n, len(names)))
                    names_.append(pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(len(names)), n))))
                    cells_.append(cells.slice(a * len(names), n * len(names)))
                    why.append(pa.nulls(n, pa.string()))
                    waiting += n
                    if waiting >= 10_000:
                        yield made()
                        rows, nums, names_, cells_, sizes, why, waiting = [], [], [], [], [], [], 0
            if rows:
                names_, cells_ = names_ or [pa.array([], pa.string())], cells_ or [pa.array([], pa.string())]
                yield made()

    reach_workers(captures.sparkSession)
    kind = captures.schema["capture_id"].dataType.simpleString()
    trouble = F.col("refusal") if "refusal" in captures.columns else F.lit(None).cast("string")
    df = captures.select("capture_id", "text", trouble.alias("trouble")).mapInArrow(run, f"capture_id {kind}, num int, cells map<string,string>, refusal string")
    if not rules:
        return df
    typed, reasons = {}, [F.col("refusal")]
    for k, rule in rules.items():
        cell = F.try_element_at("cells", F.lit(k))
        typed[k], why_ = compiled(F.when(cell != "", cell), rule, k)
        reasons.append(why_)
    return df.select("capture_id", "num", "cells", *[v.alias(k) for k, v in typed.items()], held(F.coalesce(*reasons)).alias("refusal"))


def csv_cells(text: Column, delimiter: str = ",", *, header: bool = True, columns: Sequence[str] = (), asked: Sequence[str] = ()) -> Column:
    """(rows, refusal) of each text: a map of each record, an empty cell null where it is asked for."""

    @F.arrow_udf("struct<rows:array<map<string,string>>,refusal:string>")
    def read(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            try:
                names, nums, cells = _read_csv(text.as_py(), delimiter, header, columns, set(asked))
                flat = cells.to_pylist()
                each = [list(zip(names, flat[k * len(names) : (k + 1) * len(names)], strict=True)) for k in range(len(nums))]
                out.append({"rows": [[(n, None if v == "" and n in asked else v) for n, v in row] for row in each], "refusal": None})
            except ValueError as e:
                out.append({"rows": None, "refusal": str(e)})
        return pa.array(out, pa.struct([("rows", pa.list_(pa.map_(pa.string(), pa.string()))), ("refusal", pa.string())]))

    return read(text)


def typed_columns(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``rows`` of ``csv_rows`` with columns of the types (int, float, bool) that
    are asked for; an empty cell is null, and a column that isn't there refuses
    its row."""
    if wrong := [t for t in types.values() if t not in ("int", "float", "bool")]:
        raise ValueError(f"no type {', '.join(wrong)} for a column; there are int, float, bool")
    out, reasons = {}, [F.col("refusal")]
    for k, t in types.items():
        cell = F.try_element_at("cells", F.lit(k))
        out[k], why = compiled(F.when(cell != "", cell), Field(t), k)
        reasons += [F.when(F.col("cells").isNotNull() & ~F.map_contains_key("cells", k), F.lit(f"no column {k}")), why]
    return rows.select("capture_id", "num", "cells", *[v.alias(k) for k, v in out.items()], held(F.coalesce(*reasons)).alias("refusal"))
