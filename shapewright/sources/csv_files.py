"""Strict CSV files read by all cores, however large one file is.

A file is cut where Spark cuts it, at lines, and whether a quote is open there
isn't known. Each cut is read for both cases first, which tells for either
whether one is open at its end; put together in order, one row a cut, they
tell where each begins. Then each cut is read once more for its records, some at
a time: a task holds a batch of lines and the record that is open, never its cut.
A record over several cuts is put together from its pieces. One of over 64 MiB is
refused wherever it lies.

A record that breaks a rule is a row with its reason; the others stand.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.convert import Field
from ..operators.aligned import map_reader
from ..operators.csv_text import named, quick_records, quote_open
from ..operators.lines import MOST_BYTES
from ..operators.workers import reach_workers

CUT = "path string, start long, lines long, open0 boolean, since0 long, open1 boolean, since1 long"


#: Characters of whole records that are read at a time.
STEP = 1 << 22


def _stretches(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[dict, pa.Array]]:
    """Each cut's first row as a dict of ``names``, and lines of it as they come; for all lines of a cut it is the same dict."""
    at, first = None, {}
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        differ = [pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, size - 1)) for k in (0, 1)]
        bounds = [0, *[k + 1 for k in pc.indices_nonzero(pc.or_(*differ)).to_pylist()], size]
        for begins, ends in pairwise(bounds):
            key = (batch.column(0)[begins].as_py(), batch.column(1)[begins].as_py())
            if key != at:
                at, first = key, {n: batch.column(batch.schema.get_field_index(n))[begins].as_py() for n in names}
            yield first, batch.column(2).slice(begins, ends - begins)


def _surveyed(delimiter: str):
    """What each cut does to an open quote and to none, and the line, counted from
    0 in it, at which the record began that is open at its end (-1: before the cut)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        cut = None
        for told, text in _stretches(batches, ("path", "start")):
            if told is not cut:
                cut, states, lines = told, [[False, -1], [True, -1]], 0
                out.append([cut["path"], cut["start"], 0, states])
            for k in pc.indices_nonzero(pc.match_substring(text, '"')).to_pylist():
                line = text[k].as_py()
                if not cut["start"] and not lines + k:
                    line = line.removeprefix("\ufeff")
                for state in states:
                    inside = state[0]
                    state[0] = quote_open(line, delimiter, inside)
                    if state[0] and not inside:
                        state[1] = lines + k
            lines += len(text)
            out[-1][2] = lines
        rows = [(path, start, lines, *none, *one) for path, start, lines, (none, one) in out]
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "lines", "open0", "since0", "open1", "since1"), r, strict=True)) for r in rows], schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("lines", pa.int64()), ("open0", pa.bool_()), ("since0", pa.int64()), ("open1", pa.bool_()), ("since1", pa.int64())]))

    return run


def _placed(cuts: DataFrame) -> DataFrame:
    """(path, start, first, open, since, ends_open) of each cut: the number of its first line,
    whether a quote is open at its start, the number of the line at which that record began."""

    def step(a, c):  # noqa: ANN001, ANN202
        opens = F.when(a["open"], c["open1"]).otherwise(c["open0"])
        own = F.when(a["open"], c["since1"]).otherwise(c["since0"])
        since = F.when(own >= 0, a["first"] + own).otherwise(a["since"])
        told = F.struct(c["start"].alias("start"), a["first"].alias("first"), a["open"].alias("open"), a["since"].alias("since"), opens.alias("ends_open"))
        return F.struct((a["first"] + c["lines"]).alias("first"), opens.alias("open"), since.alias("since"), F.concat(a["told"], F.array(told)).alias("told"))

    start = F.struct(F.lit(1).cast("long").alias("first"), F.lit(False).alias("open"), F.lit(-1).cast("long").alias("since"), F.array().cast("array<struct<start:bigint,first:bigint,open:boolean,since:bigint,ends_open:boolean>>").alias("told"))
    in_order = F.array_sort(F.collect_list(F.struct("start", "lines", "open0", "since0", "open1", "since1")))
    return cuts.groupBy("path").agg(in_order.alias("cuts")).select("path", F.inline(F.aggregate("cuts", start, step)["told"]))


RECORD = pa.schema([("path", pa.string()), ("num", pa.int64()), ("cells", pa.list_(pa.string())), ("refusal", pa.string())])
FIELDS = ("path", "start", "first", "open", "since")


class Cut:
    """A cut's lines as they come. Held are a step of whole records and the record
    that is open; one of over ``MOST_BYTES`` is counted and not held."""

    def __init__(self, told: dict, delimiter: str):
        self.told, self.delimiter = told, delimiter
        self.num = self.begun = told["first"]
        self.inside = self.before = told["open"]  # a quote is open; it was so before the cut
        self.held: list[str] = []
        self.size = -1  # bytes of the open record here, with a line feed between two lines
        self.whole: list[str] = []
        self.whole_from, self.whole_size = 0, 0

    def feed(self, text: pa.Array) -> Iterator[tuple[str, int, list[str], int]]:
        """What these lines complete, as (kind, number of its first line, lines, bytes): ``whole``
        records, ``large`` for one that isn't held, ``end`` for that of a record open before."""
        lines = text.to_pylist()
        if self.num == self.told["first"] and not self.told["start"]:
            lines[0] = lines[0].removeprefix("\ufeff")
        for line, size in zip(lines, pc.binary_length(text).to_pylist(), strict=True):
            was = self.inside
            if '"' in line:
                self.inside = quote_open(line, self.delimiter, was)
            if was or self.inside:
                if not was:
                    self.begun = self.num
                self.size += size + 1
                if self.size <= MOST_BYTES:
                    self.held.append(line)
                else:
                    self.held = []
                if not self.inside:
                    if self.before or self.size > MOST_BYTES:
                        yield from self.step()
                        yield "end" if self.before else "large", self.begun, self.held, self.size
                    else:
                        self._take(self.begun, self.held, self.size)
                    self.held, self.size, self.before = [], -1, False
            else:
                self._take(self.num, [line], size)
            self.num += 1
            if self.whole_size > STEP:
                yield from self.step()

    def _take(self, num: int, lines: list[str], size: int) -> None:
        if not self.whole:
            self.whole_from = num
        self.whole += lines
        self.whole_size += size + 1

    def step(self) -> Iterator[tuple[str, int, list[str], int]]:
        if self.whole:
            yield "whole", self.whole_from, self.whole, self.whole_size
        self.whole, self.whole_size = [], 0

    def close(self) -> Iterator[tuple[str, int, list[str], int]]:
        """What is left where the cut is over; ``open`` for what stays so, ``middle`` if all of the cut is one record's."""
        yield from self.step()
        if self.inside:
            yield "middle" if self.before else "open", self.begun, self.held, self.size


def _told(batches: Iterator[pa.RecordBatch], delimiter: str) -> Iterator[tuple[dict, tuple[str, int, list[str], int]]]:
    cut = None
    for told, text in _stretches(batches, FIELDS):
        if cut is None or told is not cut.told:
            if cut is not None:
                yield from ((cut.told, p) for p in cut.close())
            cut = Cut(told, delimiter)
        yield from ((told, p) for p in cut.feed(text))
    if cut is not None:
        yield from ((cut.told, p) for p in cut.close())


def _one_by_one(lines: list[str], first: int, delimiter: str) -> Iterator[tuple[int, list[str] | None, str | None]]:
    """Records of lines, each read by itself, so that one that breaks a rule stands alone."""
    held: list[str] = []
    for k, line in enumerate(lines):
        held.append(line)
        if quote_open(line, delimiter, len(held) > 1):
            continue
        num = first + k - len(held) + 1
        try:
            yield num, next(quick_records("\n".join(held) + "\n", delimiter))[1], None
        except ValueError as e:
            yield num, None, f"line {num}: {e}"
        held = []


LARGE = "a record of over 64 MiB"


def _read(delimiter: str):
    """The records that lie in one cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, (kind, num, own, _) in _told(batches, delimiter):
            if kind == "whole":
                try:
                    found = [(num + n - 1, values, None) for n, values in quick_records("\n".join(own) + "\n", delimiter)]
                except ValueError:
                    found = list(_one_by_one(own, num, delimiter))
            elif kind == "large":
                found = [(num, None, f"line {num}: {LARGE}")]
            else:
                continue
            found = [r for r in found if r[1] != [""]]
            yield pa.RecordBatch.from_arrays([pa.array([cut["path"]] * len(found), pa.string()), pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.list_(pa.string())), pa.array([r[2] for r in found], pa.string())], schema=RECORD)

    return run


def _pieces(delimiter: str):
    """(path, since, num, text, size, whole) of the pieces of records over several cuts; ``whole``
    where one ends. One of over ``MOST_BYTES`` has its size alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, (kind, num, own, size) in _told(batches, delimiter):
            if kind in ("end", "open", "middle"):
                row = (cut["path"], num if kind == "open" else cut["since"], num, "\n".join(own) if size <= MOST_BYTES else None, size, kind == "end")
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["path", "since", "num", "text", "size", "whole"])

    return run


def _mended(delimiter: str):
    """Records put together from their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    if not r["closed"]:
                        raise ValueError(f"a quote that line {r['since']} opens isn't closed")
                    if r["size"] > MOST_BYTES:
                        raise ValueError(LARGE)
                    rows.append((r["path"], r["since"], next(quick_records(r["text"] + "\n", delimiter))[1], None))
                except ValueError as e:
                    rows.append((r["path"], r["since"], None, f"line {r['since']}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], RECORD.types[k]) for k in range(4)], schema=RECORD)

    return run


def _headings(delimiter: str):
    """(path, names, head): the first record of each file that isn't blank, from its first cut, and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()
        held: dict[str, list[str]] = {}
        nums: dict[str, int] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if path in done:
                    continue
                nums[path] = nums.get(path, 0) + 1
                own = held.setdefault(path, [])
                own.append(text.removeprefix("\ufeff") if nums[path] == 1 else text)
                sizes[path] = sizes.get(path, 0) + len(text)
                if sizes[path] > MOST_BYTES:  # no heading, but a quote that stays open
                    done.add(path)
                    own.clear()
                elif own == [""] or own == ["\r"]:
                    own.clear()
                elif not quote_open(own[-1], delimiter, len(own) > 1):
                    done.add(path)
                    try:
                        names = named(next(quick_records("\n".join(own) + "\n", delimiter))[1])
                    except ValueError:
                        names = None
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([names], pa.list_(pa.string())), pa.array([nums[path] - len(own) + 1], pa.int64())], names=["path", "names", "head"])

    return run


def csv_files(spark: SparkSession, path: str, delimiter: str = ",", *, header: bool = True, columns: Sequence[str] = (), rules: Mapping[str, Field] | None = None) -> DataFrame:
    """(path, num, cells, refusal) of the records of files: a map of each, by the
    names of its file's heading or by ``columns``. Keys that have a rule are typed
    columns beside it, an empty cell null. Blank lines are left out; short records
    end in nulls, longer ones are refused. A heading lies within a file's first cut."""
    reach_workers(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))
    cuts = _placed(lines.mapInArrow(_surveyed(delimiter), CUT))
    # one row of some 50 bytes for each cut of a file, of 128 MB unless Spark is told otherwise
    placed = lines.join(F.broadcast(cuts), ["path", "start"]).select("path", "start", "text", "first", "open", "since", "ends_open")
    kind = "path string, num long, cells array<string>, refusal string"
    inside = placed.drop("ends_open").mapInArrow(_read(delimiter), kind)
    pieces = placed.filter("open or ends_open").drop("ends_open").mapInArrow(_pieces(delimiter), "path string, since long, num long, text string, size long, whole boolean")
    # the texts of a record that is too large are never put together
    pieces = pieces.withColumn("all", F.sum("size").over(Window.partitionBy("path", "since")))
    pieces = pieces.withColumn("text", F.when(F.col("all") <= MOST_BYTES, F.col("text")))
    mended = pieces.groupBy("path", "since").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("num", "text"))), lambda p: p["text"]), "\n").alias("text"), F.max("whole").alias("closed"), F.max("all").alias("size")
    ).mapInArrow(_mended(delimiter), kind)
    rows = inside.unionByName(mended)
    if header and not columns:
        heads = lines.filter("start = 0").mapInArrow(_headings(delimiter), "path string, names array<string>, head long")
        rows = rows.join(F.broadcast(heads), "path", "left").filter("head is null or num > head").drop("head")  # a row a file
    elif columns:
        rows = rows.withColumn("names", F.array(*[F.lit(c) for c in columns]))
    else:
        rows = rows.withColumn("names", F.transform("cells", lambda _, k: F.concat(F.lit("column_"), (k + 1).cast("string"))))
    long = F.concat(F.lit("line "), F.col("num").cast("string"), F.lit(" has "), F.size("cells").cast("string"), F.lit(" values for "), F.size("names").cast("string"), F.lit(" columns"))
    lacking = [F.when(~F.array_contains("names", k), F.lit(f"no column {k}")) for k in rules or {}]
    trouble = F.coalesce("refusal", F.when(F.col("names").isNull(), F.lit("a heading that can't be read")), F.when(F.size("cells") > F.size("names"), long), *lacking)
    rows = rows.withColumn("trouble", trouble).withColumn("unfit", F.lit(None).cast("string"))
    asked = F.array(*[F.lit(k) for k in rules or {}]).cast("array<string>")
    values = F.transform("names", lambda n, k: F.when(~((F.get("cells", k) == "") & F.array_contains(asked, n)), F.get("cells", k)))
    rows = rows.withColumn("cells", F.when(F.col("trouble").isNull(), F.map_from_arrays("names", values)))
    return map_reader(rules).rows_of(rows, ("cells", "trouble", "unfit"), ("path", "num"))
