"""Records from a stream of lines, equal to those of the whole text.

A stream has capture_id, num and line, and ``last`` (true on a capture's last
row, whose line may be null). Shapes that read line by line are the same plans
on a stream. Blocks and folded lines end where the next one begins, so those
need state: the open block of each capture, at most ``MOST_HELD`` bytes. What
needs all lines is held, within the same bound, until its capture ends.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.jsontext import json_of
from ..functions.steps import held
from ..functions.text import trimmed
from ..operators.csv_text import quote_open, records
from ..operators.lines import MOST_BYTES, Region, dropped, prepared
from ..operators.parse import joined_lines, settle_refusals
from ..operators.workers import reach_workers
from ..plans.build import encoded
from ..plans.identify import Signature
from ..plans.shape import DefinitionError, Shape
from .buckets import Line, by_bucket
from .units import UNITS, chosen, handled

MOST_HELD = MOST_BYTES


def stream_rows(lines: DataFrame, shape: Shape, mode: str = "fail") -> DataFrame:
    """Rows of a shape that reads each line by itself. Lines are prepared, and
    blank and ignored ones left out, as in a whole text; a region that hangs on
    lines before, or ends, is refused."""
    if not shape.checked().streams() or shape.line_reader() is None or shape.region.fold:
        raise DefinitionError(f"{shape.parse} doesn't read line by line")
    if shape.region.selects:
        raise DefinitionError("after, until, skip and limit need the lines before; select the lines first")
    one = prepared(F.array(F.struct("num", F.col("line").alias("text"))), shape.region)
    kept = dropped(one, shape.region)
    own = lines.filter(F.col("line").isNotNull()).withColumn("line", F.get(kept, F.lit(0))["text"]).filter(F.col("line").isNotNull())
    return settle_refusals(shape.line_reader().rows(own, ("capture_id", "num")), mode)


def write_json_lines(rows: DataFrame, path: str, state: str, *, omittable: Sequence[str] = (), **trigger) -> StreamingQuery:
    """Starts writing each row of a stream as one JSON line, once. A record that is
    refused ends the query; what was written before it stands."""
    return encoded(rows, omittable).writeStream.format("text").option("path", path).option("checkpointLocation", state).trigger(**trigger or {"availableNow": True}).start()


def _blocks(starts: str, joined: bool):
    """Handles a capture's new lines: the open block is the state. ``starts``
    matches a block's first line, or where ``joined`` the lines that continue one."""
    pattern = re.compile(starts)

    def run(kept: list | None, lines: list[Line], last: bool) -> tuple[list[tuple], list]:
        record, nums, texts = kept or (0, [], [])
        out, size = [], sum(len(t.encode()) for t in texts)
        for num, line in lines:
            begins = bool(pattern.search(line)) != joined
            if begins and texts:
                record += 1
                out.append((record, nums[0], texts))
                nums, texts, size = [], [], 0
            if not begins and not texts:
                raise ValueError(f"line {num} continues nothing")
            nums.append(num)
            texts.append(line)
            size += len(line.encode())
            if size > MOST_HELD:
                raise ValueError("an open record of over 64 MiB")
        if last and texts:
            record += 1
            out.append((record, nums[0], texts))
        return out, [record, nums, texts]

    return run


def _stateful(lines: DataFrame, starts: str, joined: bool) -> DataFrame:
    reach_workers(lines.sparkSession)
    return by_bucket(lines, _blocks(starts, joined), "record long, num long, texts array<string>")


def _whole(kept: list | None, lines: list[Line], last: bool) -> tuple[list[tuple], list]:
    """Holds a capture's lines until its last one."""
    held, size = kept or ([], 0)
    held.append("".join(f"{x}\n" for _, x in lines))  # a piece for each batch
    size += len(held[-1].encode())
    if size > MOST_HELD:
        raise ValueError("an open capture of over 64 MiB")
    return ([("".join(held),)] if last else []), [held, size]


def stream_captures(lines: DataFrame) -> DataFrame:
    """(capture_id, text): each capture once its last row has come."""
    reach_workers(lines.sparkSession)
    return by_bucket(lines, _whole, "text string")


def stream_units(lines: DataFrame, shape: Shape, most: int = MOST_HELD) -> DataFrame:
    """(capture_id, part, nth, lines, refusal): the lines that a value of each part
    is read from, once they have come; ``part`` is empty for a shape of no parts. A
    line that no part reads ends its capture with a refusal, as does what waits in
    it, of all parts together, beyond ``most`` bytes."""
    reach_workers(lines.sparkSession)
    one = prepared(F.array(F.struct("num", F.col("line").alias("text"))), shape.checked().region)
    own = lines.withColumn("line", F.when(F.col("line").isNotNull(), F.get(one, F.lit(0))["text"]))
    made = by_bucket(own, handled(shape, most), UNITS, together=True)
    both = F.zip_with("nums", "texts", lambda n, t: F.struct(n.cast("int").alias("num"), t.alias("text")))
    return made.select("capture_id", "part", "nth", both.alias("lines"), "refusal")


def stream_shape(lines: DataFrame, shape: Shape, mode: str = "fail", most: int = MOST_HELD) -> DataFrame:
    """Rows of any shape as soon as their lines have come, a document for each
    record, or one for each capture of a composite, which comes when it ends:
    ``stream_parts`` gives a composite's values one by one."""
    if shape.line_reader() is not None and not (shape.region.selects or shape.region.fold) and shape.region.skip_blank:
        return stream_rows(lines, shape, mode)
    if shape.parse == "composite":
        return shape.documents(stream_captures(lines), mode)
    units = stream_units(lines, shape, most)
    if shape.parse == "records":
        one = Shape("composite", Region(skip_blank=shape.region.skip_blank), parts=shape.parts)
        made = one.documents(units.withColumn("capture_id", F.struct("capture_id", F.col("nth").cast("int").alias("record"))), mode)
        return made.select("capture_id.capture_id", "capture_id.record", *[F.col(f"`{c}`") for c in made.columns if c != "capture_id"])
    return settle_refusals(shape.rows(units.withColumn("text", joined_lines(F.col("lines")))), mode)


def stream_parts(lines: DataFrame, shape: Shape, mode: str = "fail", most: int = MOST_HELD) -> DataFrame:
    """(capture_id, part, num, json) of a composite: each part's values as JSON, those
    of lists one by one, as soon as their lines have come; what is one value for
    a region's lines comes when the region is over."""
    return parts_read(stream_units(lines, shape, most), {"": shape}, mode).drop("parser")


def stream_identified(lines: DataFrame, definitions: Sequence[tuple[Signature, Shape]], mode: str = "fail", most: int = MOST_HELD) -> DataFrame:
    """(capture_id, parser, part, num, json) of captures whose definition is told
    from their first lines: these are held until no line that may come changes
    the choice, and then read by the shape chosen (``parser``: command/variant)
    as the lines after them are. No choice is a refusal."""
    reach_workers(lines.sparkSession)
    known = [(s, shape.checked()) for s, shape in definitions if not s.explicit_only]
    if len({(shape.region.strip_ansi, shape.region.separator) for _, shape in known}) > 1:
        raise DefinitionError("shapes to choose from split lines and strip escapes alike")
    one = prepared(F.array(F.struct("num", F.col("line").alias("text"))), known[0][1].region)
    own = lines.withColumn("line", F.when(F.col("line").isNotNull(), F.get(one, F.lit(0))["text"]))
    made = by_bucket(own, chosen(known, most), f"parser string, {UNITS}", together=True)
    both = F.zip_with("nums", "texts", lambda n, t: F.struct(n.cast("int").alias("num"), t.alias("text")))
    units = made.select("capture_id", "parser", "part", "nth", both.alias("lines"), "refusal")
    return parts_read(units, {f"{s.parser}/{s.variant}": shape for s, shape in known}, mode)


def parts_read(units: DataFrame, shapes: Mapping[str, Shape], mode: str) -> DataFrame:
    """(capture_id, parser, part, num, json) of units of several shapes, in one plan: a
    unit is read as its part, all others see no lines."""
    if "parser" not in units.columns:
        units = units.withColumn("parser", F.lit(""))
    df, told, why = units, F.array().cast("array<string>"), F.col("refusal")
    for parser, shape in shapes.items():
        for name, part in (shape.parts.items() if shape.parse == "composite" else [("", shape)]):
            mine = (F.col("parser") == parser) & (F.col("part") == name)
            df = df.withColumn(f"part {parser}/{name}", F.when(mine, F.col("lines")).otherwise(F.array().cast(units.schema["lines"].dataType)))
            df, value, refused, _ = part._part(df, f"{parser}/{name}", F.col(f"`part {parser}/{name}`"))
            shown = df.select(value.alias("v")).schema["v"].dataType
            each = F.transform(value, lambda x: json_of(x, shown.elementType, "", 0)) if isinstance(shown, T.ArrayType) and part.parse != "ini" else F.array(json_of(value, shown, "", 0))  # noqa: B023
            told = F.when(mine, each).otherwise(told)
            why = F.coalesce(why, F.when(mine, refused))
    none = F.array(F.lit(None).cast("string"))
    df = df.select("capture_id", "parser", "part", F.get("lines", F.lit(-1) + F.size("lines"))["num"].alias("num"), held(why).alias("refusal"), told.alias("told"))
    rows = df.select("capture_id", "parser", "part", "num", F.explode(F.when(F.col("refusal").isNotNull(), none).otherwise(F.col("told"))).alias("json"), "refusal")
    return settle_refusals(rows, mode)


def stream_blocks(lines: DataFrame, start: str) -> DataFrame:
    """(capture_id, record, num, texts): blocks that begin at a match of
    ``start``, each handed over once the next one begins or the capture ends."""
    return _stateful(lines, start, False)


def stream_folded(lines: DataFrame, pattern: str) -> DataFrame:
    """(capture_id, num, line): lines with those that match joined to them."""
    return _stateful(lines, pattern, True).select("capture_id", "num", F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.array_join(F.transform("texts", lambda t: trimmed(t)), " ")).alias("line"))


def stream_trees(lines: DataFrame) -> DataFrame:
    """(capture_id, record, num, texts): top-level nodes of an indented tree, each
    handed over once the next one begins or the capture ends."""
    return stream_blocks(lines.filter(F.col("line").isNull() | (trimmed(F.col("line")) != "")), r"^\S")


def _csv(delimiter: str):
    """Handles a capture's new lines: those since an open quote are the state, and whether it is open."""

    def run(kept: list | None, lines: list[Line], last: bool) -> tuple[list[tuple], list]:
        record, num, held_, size = kept or (0, 0, [], 0)
        out = []
        for at, line in lines:
            inside = bool(held_)
            num = num if inside else at
            held_.append(line)
            size += len(line.encode()) + 1
            if size > MOST_HELD:
                raise ValueError("an open record of over 64 MiB")
            if not quote_open(line, delimiter, inside):
                record += 1
                out.append((record, num, next(records("\n".join(held_) + "\n", delimiter))[1]))
                held_, size = [], 0
        if last and held_:
            raise ValueError(f"a quote that line {num} opens isn't closed")
        return out, [record, num, held_, size]

    return run


def stream_csv(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """(capture_id, record, num, cells): CSV records, each handed over once no
    quote is open at its line's end; the first has the headings."""
    reach_workers(lines.sparkSession)
    return by_bucket(lines, _csv(delimiter), "record long, num long, cells array<string>")
