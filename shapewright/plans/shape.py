"""A declarative shape of a text, compiled to a Spark plan.

The shape alone decides the output schema: it is never inferred from values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import KINDS, Field
from ..functions.jsontext import json_of
from ..functions.patterns import translate
from ..functions.text import let
from ..operators import aligned, csv_text, parse
from ..operators.lines import Region, dropped, exploded, read_by, regioned, selected, unread_refusal
from ..operators.workers import reach_workers

#: Limits of a definition.
MOST_COLUMNS, MOST_PARTS, MOST_ALTERNATIVES, MOST_NESTING = 256, 32, 16, 8
#: Fixed value: what one document may keep.
MOST_VALUES = 4_194_304
PARSES = ("regex", "regex_input", "table", "aligned", "box", "csv", "kv_list", "kv_map", "ini", "tree", "records", "composite", "ltsv")


class DefinitionError(ValueError):
    """A shape that breaks a rule; the message lists every problem."""


@dataclass(frozen=True)
class Shape:
    """How a text is cut, dropped, selected, parsed and typed."""

    parse: str
    region: Region = field(default_factory=Region)
    patterns: Sequence = ()
    columns: Sequence[str] = ()
    fields: Mapping[str, Field] = field(default_factory=dict)
    separator: str = "="
    delimiter: str | None = None
    header: bool = False
    derived: bool = False
    rename: Mapping[str, str] = field(default_factory=dict)
    leading_label: str = ""
    most: int | None = None
    least: int | None = None
    indent: str | Sequence[str] = "  "
    root: str = ""
    start: str = ""
    node: Shape | None = None
    keep_space: bool = False
    unquote: bool = False
    parts: Mapping[str, Shape] = field(default_factory=dict)
    raw: bool = False

    def problems(self, nesting: int = 0) -> list[str]:
        found = []
        if self.parse not in PARSES:
            found.append(f"parse: {self.parse} isn't one of {', '.join(PARSES)}")
        if self.parse in ("regex", "regex_input") and not 0 < len(self.patterns) <= MOST_ALTERNATIVES:
            found.append(f"patterns: 1 to {MOST_ALTERNATIVES}")
        if self.parse in ("table", "aligned") and not self.columns and not self.derived:
            found.append("columns: a table needs them, unless they are derived from its header")
        if self.derived and self.columns:
            found.append("columns: written out, or derived from the header, not both")
        if self.derived and self.parse not in ("table", "csv", "aligned"):
            found.append("derived: only a table's columns are")
        if self.rename and not self.derived or self.leading_label and not (self.derived or self.parse == "aligned"):
            found.append("rename, leading_label: only for names derived from a header; an aligned table may have the label besides")
        if (self.keep_space or self.unquote) and self.parse != "kv_list":
            found.append("keep_space, unquote: only for a list of pairs")
        if self.fields and self.parse in ("tree", "records", "composite", "ltsv"):
            found.append("fields: a tree's are its node's, and those of records and composites their parts'; LTSV has none")
        if self.node and (self.parse != "tree" or self.node.parse not in ("regex", "kv_list")):
            found.append("node: a tree's, read by patterns or as a pair")
        if self.root and self.parse != "tree":
            found.append("root: only a tree's")
        if self.parse == "records" and any(p.parse == "tree" for p in self.parts.values()):
            found.append("parts: no tree in records")
        if len(self.columns) > MOST_COLUMNS or len(set(self.columns)) < len(self.columns) or "" in self.columns:
            found.append(f"columns: at most {MOST_COLUMNS}, each named once")
        if self.parse in ("records", "composite") and not 0 < len(self.parts) <= MOST_PARTS:
            found.append(f"parts: 1 to {MOST_PARTS}")
        if self.parse == "records" and not self.start:
            found.append("start: records need it")
        if self.parse == "records" and any(p.parse == "records" for p in self.parts.values()):
            found.append("parts: no records in records")
        if self.parse in ("records", "composite") and any(p.parse == "composite" for p in self.parts.values()):
            found.append("parts: no composite in parts")
        if nesting > MOST_NESTING:
            found.append(f"nesting: over {MOST_NESTING}")
        for key, rule in self.fields.items():
            if rule.type not in KINDS:
                found.append(f"fields.{key}: {rule.type} isn't a type")
            if rule.type == "array" and rule.items and rule.items.type == "array":
                found.append(f"fields.{key}: no arrays of arrays")
        for text in [self.region.fold, self.region.after, self.region.until, self.start, self.root, *self.region.ignore, *[p if isinstance(p, str) else p[0] for p in self.patterns]]:
            try:
                translate(text)
            except ValueError as e:
                found.append(f"{text[:40]}: {e}")
        if self.node:
            found += [f"node: {x}" for x in self.node.problems(nesting + 1)]
        for name, part in self.parts.items():
            found += [f"{name}: {x}" for x in part.problems(nesting + 1)]
        return found

    def checked(self) -> Shape:
        if found := self.problems():
            raise DefinitionError("; ".join(found))
        return self

    def streams(self) -> bool:
        """Whether records come one by one; one value for all of the text doesn't."""
        return self.parse not in ("kv_map", "ini", "regex_input")

    def without_rules(self) -> Shape:
        """The same shape with cells left as text."""
        return replace(self, raw=True)

    def line_reader(self) -> parse.LineReader | None:
        """The steps that read one line, if the shape reads line by line."""
        if self.header or self.derived:
            return None
        if self.parse == "regex":
            return parse.regex_reader(self.patterns, self.fields, self.raw)
        if self.parse == "table":
            return parse.table_reader(self.columns, self.fields, delimiter=self.delimiter, most=self.most, least=self.least, raw=self.raw)
        if self.parse == "kv_list":
            return parse.kv_reader(self.separator, self.fields, keep_space=self.keep_space, unquote=self.unquote, raw=self.raw)
        return parse.ltsv_reader() if self.parse == "ltsv" else None

    def rows(self, captures: DataFrame) -> DataFrame:
        """Rows with capture_id, keys and refusal; a capture that is refused as a
        whole has one row that says why."""
        if self.parse == "composite":
            raise DefinitionError("a composite has a DataFrame for each part: use read_parts, or documents")
        if self.parse == "csv":
            return csv_text.csv_rows(captures, self.delimiter or ",", header=self.header or not self.columns, columns=self.columns, rules={} if self.raw else self.fields)
        df = captures if "lines" in captures.columns else regioned(captures, self.region)
        if reader := self.line_reader():
            return reader.rows(exploded(df), ("capture_id", "num"))
        if self.parse == "table" and self.derived:
            return parse.derived_table(df, self.fields, delimiter=self.delimiter, most=self.most, least=self.least, rename=self.rename, leading_label=self.leading_label, raw=self.raw)
        if self.parse == "table":
            return parse.headed_table(df, self.fields, columns=self.columns, delimiter=self.delimiter, most=self.most, least=self.least, raw=self.raw)
        if self.parse == "regex_input":
            return parse.regex_input(df, self.patterns, self.fields, raw=self.raw)
        if self.parse == "aligned" and self.derived:
            return aligned.aligned_derived(df, self.fields, rename=self.rename, leading_label=self.leading_label, raw=self.raw)
        if self.parse == "aligned":
            return aligned.aligned_rows(df, self.columns, self.fields, leading_label=self.leading_label, raw=self.raw)
        if self.parse == "box":
            return aligned.box_rows(df, self.fields, raw=self.raw)
        if self.parse == "kv_map":
            return parse.kv_map(df, self.separator, {} if self.raw else self.fields)
        if self.parse == "ini":
            return parse.ini_sections(df, self.separator, {} if self.raw else self.fields)
        if self.parse == "tree":
            return parse.tree_nodes(df, self.indent, root=self.root, reader=self.node and self.node.line_reader())
        return parse.record_blocks(df, self.start)

    def read(self, captures: DataFrame, mode: str = "fail") -> DataFrame:
        """The typed rows of all captures; refusals end the query, or with
        ``report`` stay as a column."""
        return parse.settle_refusals(self.checked().rows(captures), mode)

    def parted(self, captures: DataFrame) -> DataFrame:
        """``captures`` of a composite or of records (a row for each), with
        ``part <name>``, each part's lines, and refusal: a line that no part
        reads refuses its capture."""
        self.checked()
        df = captures if "lines" in captures.columns else regioned(captures, self.region)
        if self.parse == "records":
            df = parse.record_blocks(df, self.start)
        read = []
        for name, part in self.parts.items():
            df = df.withColumn(f"part {name}", part_lines(F.col("lines"), part.region))
            read.append(part_numbers(F.col("lines"), part.region))
        return df.withColumn("refusal", parse.held(F.coalesce("refusal", unread_refusal(F.col("lines"), F.concat(*read)))))

    def read_parts(self, captures: DataFrame, mode: str = "fail") -> dict[str, DataFrame]:
        """Each part's rows, of a composite or of records; a record's number is
        kept. Every part reads the captures anew; ``documents`` reads them once."""
        df = self.parted(captures)
        if self.parse == "records":
            df = df.withColumn("capture_id", F.struct("capture_id", "record"))
        return {name: parse.settle_refusals(part.rows(df.select("capture_id", "refusal", F.col(f"`part {name}`").alias("lines"))), mode) for name, part in self.parts.items()}

    def nested(self, captures: DataFrame, mode: str = "fail") -> DataFrame:
        """(capture_id, json, tree) of a tree: a list of nodes, each with the keys
        that ``node`` reads (or its text) and the list of its children, as JSON in
        the keys' order and as a nested value."""
        self.checked()
        df = captures if "lines" in captures.columns else regioned(captures, self.region)
        refusal = F.col("refusal") if "refusal" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("read", self._tree(df.sparkSession, F.col("lines")))
        return parse.settle_refusals(df.select("capture_id", F.col("read.json").alias("json"), F.parse_json("read.json").alias("tree"), parse.held(F.coalesce(refusal, F.col("read.refusal"))).alias("refusal")), mode)

    def _tree(self, spark: SparkSession, lines: Column) -> Column:
        reader = (self.node or Shape("regex", patterns=[r"^(?P<text>.*)$"])).line_reader()
        kinds = reader.rows(spark.createDataFrame([], "line string"), ()).schema
        member = lambda value, key: json_of(value, kinds[key].dataType if key else T.StringType(), "", 0)
        return parse.tree_value(lines, self.indent, root=self.root, reader=reader, member=member)

    def _part(self, df: DataFrame, name: str, at: Column) -> tuple[DataFrame, Column, Column, Column]:
        """``df`` with what a part's lines give, and that value, why it is refused, and how many values it has."""
        rules = {} if self.raw else self.fields
        here = F.col(f"`read {name}`")
        first = lambda rows: F.get(F.array_compact(F.transform(rows, lambda x: x["refusal"])), F.lit(0))
        if reader := self.line_reader():
            df, value, refusal = reader.read_each(df, f"read {name}", F.transform(at, lambda v: v["text"]))
            return df, value, refusal, F.size(at) * len(reader.keys)
        if self.parse == "regex_input":
            reader = parse.regex_reader(self.patterns, self.fields, self.raw)
            df = df.withColumn(f"read {name}", F.get(reader.values(F.array(parse.joined_lines(at))), F.lit(0)))
            return df, F.struct(*[here[k].alias(k) for k in reader.keys]), here["refusal"], F.lit(len(reader.keys))
        if self.parse == "kv_map":
            return df.withColumn(f"read {name}", parse.map_value(at, self.separator, rules)), here["pairs"], here["refusal"], F.coalesce(F.size(here["pairs"]), F.lit(0))
        if self.parse == "ini":
            df = df.withColumn(f"read {name}", parse.ini_value(at, self.separator, rules))
            return df, here["sections"], here["refusal"], F.aggregate(here["sections"], F.lit(0), lambda n, x: n + F.coalesce(F.size(x["pairs"]), F.lit(0)))
        if self.parse == "tree":
            return df.withColumn(f"read {name}", self._tree(df.sparkSession, at)), F.parse_json(here["json"]), here["refusal"], F.size(at)
        if self.parse == "table":
            if self.derived:
                reader = parse.derived_reader(self.fields, delimiter=self.delimiter, most=self.most, least=self.least, raw=self.raw)
                read = parse.derived_value(at, reader, delimiter=self.delimiter, rename=self.rename, leading_label=self.leading_label)
            else:
                reader = parse.table_reader(self.columns, self.fields, delimiter=self.delimiter, most=self.most, least=self.least, raw=self.raw)
                read = parse.headed_value(at, self.columns, self.delimiter, reader)
            return df.withColumn(f"read {name}", read), _only(here["rows"], reader.keys), F.coalesce(here["refusal"], first(here["rows"])), F.size(here["rows"]) * len(reader.keys)
        # what is cut in Arrow batches: an array of cells for each line, or of maps, and then typed like others
        reach_workers(df.sparkSession)
        none = F.lit(None).cast("string")
        if self.parse == "aligned":
            lines, reader, cut = aligned.aligned_value(at, None if self.derived else self.columns, rules, rename=self.rename, leading_label=self.leading_label, raw=self.raw)
            df = df.withColumn(f"lines {name}", lines)
            df = df.withColumn(f"cut {name}", cut(F.col(f"`lines {name}`")))

            def typed(v: Column, c: Column) -> Column:
                if not self.derived:
                    return reader.value(c["cells"])
                return reader.value_of({"names": c["names"], "cells": c["cells"], "trouble": parse.alike(c["names"]), "unfit": F.when(c["cells"].isNull(), F.concat(F.lit("not aligned: "), v["text"]))})

            df = df.withColumn(f"read {name}", F.zip_with(F.col(f"`lines {name}`"), F.col(f"`cut {name}`"), typed))
            return df, _only(here, reader.keys), first(here), F.size(here) * len(reader.keys)
        reader = parse.map_reader(rules)
        cut = aligned.box_cells(at) if self.parse == "box" else csv_text.csv_cells(parse.joined_lines(at), self.delimiter or ",", header=self.header or not self.columns, columns=self.columns, asked=list(rules))
        df = df.withColumn(f"cut {name}", cut)
        rows = F.transform(F.col(f"`cut {name}`")["rows"], lambda m: reader.value_of({"cells": m, "trouble": none, "unfit": none}))
        df = df.withColumn(f"read {name}", rows)
        return df, _only(here, reader.keys), F.coalesce(F.col(f"`cut {name}`")["refusal"], first(here)), F.coalesce(F.size(here), F.lit(0)) * len(reader.keys)

    def documents(self, captures: DataFrame, mode: str = "fail") -> DataFrame:
        """A row for each capture (or record: its number is beside it) with a
        column for each part: the structs of its lines, in order, or one value
        where the part is read as a whole (patterns over all lines, a map, a tree's
        nested value, sections). No rows are shuffled or joined."""
        df = self.parted(captures)
        keep = ["capture_id", "record"] if self.parse == "records" else ["capture_id"]
        values, reasons, n_values = [], [F.col("refusal")], F.lit(0)
        for name, part in self.parts.items():
            df, value, why, many = part._part(df, name, F.col(f"`part {name}`"))
            values.append(value.alias(name))
            reasons.append(why)
            n_values = n_values + many
        reasons.append(F.when(n_values > MOST_VALUES, F.lit(f"over {MOST_VALUES} values")))
        return parse.settle_refusals(df.select(*keep, *values, parse.held(F.coalesce(*reasons)).alias("refusal")), mode)

    def schema(self, spark: SparkSession) -> T.StructType:
        """The output's schema, known before any text is."""
        empty = spark.createDataFrame([], "capture_id string, text string")
        made = self.read(empty, "report")
        fields = []
        for f in made.schema.fields:
            rule = self.fields.get(f.name)
            meta = {"omittable": bool(rule and rule.omit), "required": bool(rule and rule.required)}
            fields.append(T.StructField(f.name, f.dataType, not meta["required"], meta))
        return T.StructType(fields)


def _only(read: Column, keys: Sequence[str]) -> Column:
    return F.transform(read, lambda x: F.struct(*[x[k].alias(k) for k in keys]))


def part_lines(lines: Column, region: Region) -> Column:
    """A part's lines: selected, then without blank and ignored ones, which a sibling must read."""
    return let(selected(lines, region), lambda s: dropped(s, region))


def part_numbers(lines: Column, region: Region) -> Column:
    """Numbers of the lines that a part accounts for."""
    if not region.ignore:
        return read_by(lines, region, end=False)
    own = let(selected(lines, region), lambda s: F.transform(dropped(s, region), lambda v: v["num"]))
    heading = F.array_except(read_by(lines, region, end=False), let(selected(lines, region), lambda s: F.transform(s, lambda v: v["num"])))
    return F.concat(own, heading)


def changes(old: T.StructType, new: T.StructType) -> list[tuple[str, str]]:
    """(key, kind) of what differs: removed, type, required, optional, added."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    found = [(k, "removed") for k in a if k not in b] + [(k, "added") for k in b if k not in a]
    for k in a.keys() & b.keys():
        if a[k].dataType != b[k].dataType:
            found.append((k, "type"))
        elif a[k].nullable != b[k].nullable:
            found.append((k, "optional" if b[k].nullable else "required"))
    return sorted(found)
