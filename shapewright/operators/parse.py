"""The parse types, each a DataFrame of rows from a DataFrame of lines.

A line table has capture_id, num and line, and may have ``trouble``, why the
line's capture is refused. Each function returns capture_id, num, the keys and
``refusal``, the reason why a line isn't read (null if it is).
``settle_refusals`` turns refusals into errors, or leaves them as rows.

What reads single lines is a ``LineReader``: steps that work on a table of lines
and on the elements of an array of them alike.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import Field, Text, as_text, as_value, compiled, why_not
from ..functions.patterns import CUT, Found, Pattern, linear_matches, match_array, translate
from ..functions.steps import Step, bound, held, projected, quoted, quoted_name
from ..functions.text import BLANK, cells_of, is_blank, let, literal, normal_names, trimmed
from .lines import blocks, exploded, indexes

#: Fixed value: levels of a tree.
MOST_LEVELS = 32
#: Finds, among cells joined by marks, one that isn't an integer of at most 18 digits.
LONG = rf"(?:\A|{CUT})(?![+-]?[0-9]{{1,18}}(?:{CUT}|\z))"
#: Lines of a tree whose parents are gathered at a time.
TREE_BLOCK = 256


@dataclass(frozen=True)
class LineReader:
    """Steps from ``line`` to the columns ``value <key>`` and ``refusal``. Where
    ``linear`` names patterns that the JVM's stack can't take, their match is
    found outside the steps, for all lines at once."""

    steps: Sequence[Step]
    keys: Sequence[str]
    linear: Sequence[Pattern] = ()
    alternatives: Sequence[Sequence[str]] = ()
    #: A pattern whose groups are the keys, and those of them that are integers; the others are text.
    plain: tuple[Pattern, frozenset[str]] | None = None

    def rows(self, df: DataFrame, keep: Sequence[str], text: str = "line") -> DataFrame:
        given = {"line": quoted(text)} | ({"trouble": F.col("trouble")} if "trouble" in df.columns else {})
        if self.linear:
            given["match"] = F.get(linear_matches(F.array(quoted(text)), self.linear), F.lit(0))
        return self._projected(df, keep, given)

    def rows_of(self, df: DataFrame, given: Sequence[str], keep: Sequence[str] = ("capture_id", "num")) -> DataFrame:
        """Rows, of steps that read other columns than the line."""
        return self._projected(df, keep, {c: F.col(c) for c in given})

    def _projected(self, df: DataFrame, keep: Sequence[str], given: Mapping[str, Column]) -> DataFrame:
        made = projected(df, keep, self.steps, given)
        return made.select(*[quoted(k) for k in keep], *[quoted(f" value {k}").alias(k) for k in self.keys], held(quoted(" refusal")).alias("refusal"))

    def value(self, line: Column) -> Column:
        """A struct of the keys and refusal of one line."""
        return self.value_of({"line": line})

    def value_of(self, given: Mapping[str, Column]) -> Column:
        return bound(given, self.steps, lambda env: F.struct(*[env[f"value {k}"].alias(k) for k in self.keys], env["refusal"].alias("refusal"), env.get("which", F.lit(0)).alias("which")))

    def values(self, texts: Column) -> Column:
        """``value`` of each of an array of lines, which is a column and no lambda's."""
        if self.linear:
            return F.zip_with(texts, linear_matches(texts, self.linear), lambda t, m: self.value_of({"line": t, "match": m}))
        return F.transform(texts, self.value)

    def read_each(self, df: DataFrame, name: str, texts: Column) -> tuple[DataFrame, Column, Column]:
        """``df`` with what an array of lines gives, the structs of their keys, and the
        first refusal. Spark interprets what is inside a lambda, node by node; so the
        lines of a ``plain`` reader are only matched there. If all of them match
        whole, and their integers are short ones, the arrays of cells are cast as
        arrays; else every line goes through the steps."""
        here = quoted(name)
        only = F.transform(here, lambda x: F.struct(*[x[k].alias(k) for k in self.keys]))
        refusal = F.get(F.array_compact(F.transform(here, lambda x: x["refusal"])), F.lit(0))
        if self.plain is None:
            return df.withColumn(name, self.values(texts)), only, refusal
        pattern, ints = self.plain
        df = df.withColumn(f"texts {name}", held(texts))
        found = quoted(f"match {name}")
        df = df.withColumn(f"match {name}", held(F.transform(quoted(f"texts {name}"), lambda t: match_array(t, (pattern,)))))
        fine = ~F.exists(found, lambda m: F.coalesce((F.get(m, F.lit(2)) != "") | (F.get(m, F.lit(3)) != ""), F.lit(True)))
        cells = {k: held(F.transform(found, lambda m: F.get(m, F.lit(4 + n)))) for n, k in enumerate(pattern.groups)}  # noqa: B023
        df = df.select("*", held(fine).alias(f"whole {name}"), *[c.alias(f"cell {k} {name}") for k, c in cells.items()])
        own = {k: quoted(f"cell {k} {name}") for k in cells}
        short = quoted(f"whole {name}")
        for k in ints:  # no cell holds the mark between them, as no text that is matched does
            short = short & ~F.array_join(own[k], CUT).rlike(LONG)
        df = df.withColumn(f"short {name}", held(F.coalesce(short, F.lit(False))))
        df = df.withColumn(name, held(F.when(~quoted(f"short {name}"), self.values(quoted(f"texts {name}")))))
        zipped = F.arrays_zip(*[own[k].try_cast("array<bigint>") if k in ints else own[k] for k in self.keys])
        kinds = ",".join(f"{quoted_name(k)}:{'bigint' if k in ints else 'string'}" for k in self.keys)
        return df, F.when(quoted(f"short {name}"), zipped.cast(f"array<struct<{kinds}>>")).otherwise(only), F.when(~quoted(f"short {name}"), refusal)


def _typing(rules: Mapping[str, Field], keys: Sequence[str], raw: bool) -> list[Step]:
    """Steps from ``cell <key>`` and ``unread``, the reason against the line, to
    the typed values and the first reason against any."""
    ruled = {} if raw else {k: rules[k] for k in keys if k in rules}

    def texts(env: Mapping[str, Column]) -> dict[str, Column]:
        out: dict[str, Column] = {}
        cells = {k: env[f"cell {k}"] for k in keys}
        for k, rule in ruled.items():
            got = as_text(cells[k], rule, cells)
            out |= {f"text {k}": got.text, f"missing {k}": got.missing, f"unfit {k}": got.unfit}
            if got.groups is not None:
                out[f"groups {k}"] = got.groups
        return out or {"no rule": F.lit(True)}

    def text_of(env: Mapping[str, Column], k: str) -> Text:
        return Text(env[f"text {k}"], env[f"missing {k}"], env[f"unfit {k}"], env.get(f"groups {k}"))

    def values(env: Mapping[str, Column]) -> dict[str, Column]:
        out = {}
        for k in keys:
            out[f"value {k}"], inner = as_value(text_of(env, k), ruled[k], k) if k in ruled else (env[f"cell {k}"], None)
            if inner is not None:
                out[f"inner {k}"] = inner
        return out

    def reasons(env: Mapping[str, Column]) -> dict[str, Column]:
        found = [env["trouble"]] if "trouble" in env else []
        found.append(env["unread"])
        found += [why_not(env[f"cell {k}"], text_of(env, k), env[f"value {k}"], env.get(f"inner {k}"), rule, k) for k, rule in ruled.items()]
        return {"refusal": F.coalesce(*found)}

    return [texts, values, reasons]


def _options(patterns: Sequence[str | tuple[str, Mapping[str, str]]]):
    return [(translate(p), {}) if isinstance(p, str) else (translate(p[0]), dict(p[1])) for p in patterns]


def regex_reader(patterns: Sequence[str | tuple[str, Mapping[str, str]]], rules: Mapping[str, Field] | None = None, raw: bool = False) -> LineReader:
    """The first of the alternatives that matches gives the keys by its named
    groups, and by its constants; keys of other alternatives are null. A line
    that none matches, or that the match doesn't cover, is refused."""
    options = _options(patterns)
    known = tuple(p for p, _ in options)
    names = list(dict.fromkeys(n for p, fixed in options for n in (*fixed, *p.groups)))
    deep = any(p.deep for p in known)
    ruled = {} if raw else {k: r for k, r in (rules or {}).items() if k in names}
    plain = None
    if len(options) == 1 and names and not (deep or options[0][1] or known[0].optional) and all(r in (Field("int"), Field("int", required=True)) for r in ruled.values()):
        plain = known[0], frozenset(ruled)

    def matched(env: Mapping[str, Column]) -> dict[str, Column]:
        return {"match": match_array(env["line"], known)}

    def cells(env: Mapping[str, Column]) -> dict[str, Column]:
        found = Found(env["match"], known)
        out = {}
        for name in names:
            cell = None
            for k, (pattern, fixed) in enumerate(options):
                if name in fixed or name in pattern.groups:
                    own = F.lit(fixed[name]) if name in fixed else found.group(k, name)
                    cell = F.when(found.which == k, own) if cell is None else cell.when(found.which == k, own)
            out[f"cell {name}"] = cell
        told = F.coalesce(env["line"], F.lit(""))
        out["which"] = found.which
        out["unread"] = F.when(found.which.isNull(), F.concat(F.lit("no alternative matches: "), told)).when(~found.covers, F.concat(F.lit("the match leaves text: "), told))
        return out

    return LineReader([*([] if deep else [matched]), cells, *_typing(rules or {}, names, raw)], names, known if deep else (), [(*fixed, *p.groups) for p, fixed in options], plain)


def table_reader(columns: Sequence[str], rules: Mapping[str, Field] | None = None, *, delimiter: str | None = None, most: int | None = None, least: int | None = None, raw: bool = False) -> LineReader:
    """Cells between white space, or between a delimiter, one for each column.

    The last column takes what is left, up to ``most`` cells in all; a ``most``
    above the columns' number refuses a longer row. Rows of fewer than
    ``least`` cells are refused, and shorter ones end in nulls.
    """
    most = most or len(columns)

    def cut(env: Mapping[str, Column]) -> dict[str, Column]:
        at = env["line"]
        return {"cells": cells_of(at, most) if delimiter is None else F.transform(F.split(at, literal(delimiter), most), trimmed)}

    def cells(env: Mapping[str, Column]) -> dict[str, Column]:
        size = F.size(env["cells"])
        refusal = F.when(size > len(columns), F.concat(F.lit("too many cells: "), env["line"])).when(size < (least or 1), F.concat(F.lit("too few cells: "), env["line"]))
        return {"unread": refusal} | {f"cell {c}": F.get(env["cells"], F.lit(k)) for k, c in enumerate(columns)}

    return LineReader([cut, cells, *_typing(rules or {}, columns, raw)], columns)


def cells_reader(columns: Sequence[str], rules: Mapping[str, Field] | None = None, raw: bool = False) -> LineReader:
    """Cells that are cut already: ``line`` is an array of them, null if it couldn't be."""

    def cells(env: Mapping[str, Column]) -> dict[str, Column]:
        return {"unread": F.when(env["line"].isNull(), F.lit("not aligned"))} | {f"cell {c}": F.get(env["line"], F.lit(k)) for k, c in enumerate(columns)}

    return LineReader([cells, *_typing(rules or {}, columns, raw)], columns)


def kv_reader(separator: str = "=", rules: Mapping[str, Field] | None = None, *, keep_space: bool = False, unquote: bool = False, raw: bool = False) -> LineReader:
    """name and value of each line, at the first separator; a rule for the name
    of a key is applied to the text of its value."""

    def cut(env: Mapping[str, Column]) -> dict[str, Column]:
        parts = F.split(env["line"], literal(separator), 2)
        name, value = (F.get(parts, F.lit(k)) if keep_space else trimmed(F.get(parts, F.lit(k))) for k in (0, 1))
        return {"name": name, "text": value}

    def typed(env: Mapping[str, Column]) -> dict[str, Column]:
        name, value = env["name"], env["text"]
        reasons = [env["trouble"]] if "trouble" in env else []
        reasons += [F.when(value.isNull(), F.concat(F.lit("no separator: "), env["line"])), F.when(trimmed(name) == "", F.concat(F.lit("no name: "), env["line"]))]
        if unquote:
            value = F.when(value.rlike(r"\A(?:\"[^\"]*\"|'[^']*')\z"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        shown = value
        for key, rule in ({} if raw else rules or {}).items():
            got, why = compiled(F.when(name == key, value), rule, key)
            shown = F.when(name == key, got.cast("string")).otherwise(shown)
            reasons.append(F.when(name == key, why))
        return {"value name": name, "value value": shown, "refusal": F.coalesce(*reasons)}

    return LineReader([cut, typed], ["name", "value"])


def ltsv_reader() -> LineReader:
    """``label:value`` between tabs, a map for each line. A missing colon, a bad
    label or a label twice is refused."""

    def cut(env: Mapping[str, Column]) -> dict[str, Column]:
        return {"cells": F.transform(F.split(env["line"], "\t"), lambda c: F.split(c, ":", 2))}

    def judged(env: Mapping[str, Column]) -> dict[str, Column]:
        names = F.transform(env["cells"], lambda p: F.get(p, F.lit(0)))
        bad = F.exists(env["cells"], lambda p: (F.size(p) < 2) | ~F.get(p, F.lit(0)).rlike(r"\A[0-9A-Za-z_.-]+\z"))
        reasons = [env["trouble"]] if "trouble" in env else []
        reasons.append(F.when(bad, F.concat(F.lit("not label:value: "), env["line"])).when(F.size(F.array_distinct(names)) < F.size(names), F.concat(F.lit("a label twice: "), env["line"])))
        return {"names": names, "refusal": F.coalesce(*reasons)}

    def made(env: Mapping[str, Column]) -> dict[str, Column]:
        pairs = F.map_from_arrays(env["names"], F.transform(env["cells"], lambda p: F.get(p, F.lit(1))))
        return {"value pairs": F.when(env["refusal"].isNull(), pairs)}

    return LineReader([cut, judged, made], ["pairs"])


def regex_lines(df: DataFrame, patterns: Sequence[str | tuple[str, Mapping[str, str]]], rules: Mapping[str, Field] | None = None, *, text: str = "line", keep: Sequence[str] = ("capture_id", "num"), raw: bool = False) -> DataFrame:
    """Rows of ``regex_reader``."""
    return regex_reader(patterns, rules, raw).rows(df, keep, text)


def regex_input(captures: DataFrame, patterns: Sequence[str | tuple[str, Mapping[str, str]]], rules: Mapping[str, Field] | None = None, raw: bool = False) -> DataFrame:
    """One match against all of a capture's lines, joined by newlines."""
    whole = captures.withColumn("line", joined_lines(F.col("lines")))
    if "refusal" in captures.columns:
        whole = whole.withColumn("trouble", F.col("refusal"))
    return regex_reader(patterns, rules, raw).rows(whole, ("capture_id",))


def joined_lines(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda v: v["text"]), "\n")


def table_rows(df: DataFrame, columns: Sequence[str], rules: Mapping[str, Field] | None = None, *, delimiter: str | None = None, most: int | None = None, least: int | None = None, raw: bool = False) -> DataFrame:
    """Rows of ``table_reader``."""
    return table_reader(columns, rules, delimiter=delimiter, most=most, least=least, raw=raw).rows(df, ("capture_id", "num"))


def kv_list(df: DataFrame, separator: str = "=", rules: Mapping[str, Field] | None = None, *, keep_space: bool = False, unquote: bool = False, raw: bool = False) -> DataFrame:
    """Rows of ``kv_reader``."""
    return kv_reader(separator, rules, keep_space=keep_space, unquote=unquote, raw=raw).rows(df, ("capture_id", "num"))


def ltsv_rows(df: DataFrame) -> DataFrame:
    """Rows of ``ltsv_reader``."""
    return ltsv_reader().rows(df, ("capture_id", "num"))


def _spaced(text: Column) -> Column:
    return F.regexp_replace(trimmed(text), f"{BLANK}+", " ")


def _head_names(header: Column, delimiter: str | None, rename: Mapping[str, str], leading_label: str) -> Column:
    """Keys of a header's names."""
    heads = cells_of(header) if delimiter is None else F.transform(F.split(header, literal(delimiter)), trimmed)
    names = F.transform(heads, normal_names)
    if rename:
        given = F.create_map(*[F.lit(x) for pair in rename.items() for x in pair])
        names = F.transform(names, lambda n: F.coalesce(F.try_element_at(given, n), n))
    if leading_label:
        names = F.concat(F.array(F.lit(leading_label)), names)
    return names


def same_heading(delimiter: str | None) -> Callable[[Column], Column]:
    """What is alike for two lines that head the same columns."""
    if delimiter is None:
        return _spaced
    return lambda t: F.array_join(F.transform(F.split(t, literal(delimiter)), trimmed), "\x00")


def below_header(lines: Column, delimiter: str | None) -> Column:
    """(header, lines): the first line, and the others but those that repeat it."""
    same = same_heading(delimiter)
    head = F.get(lines, F.lit(0))["text"]
    return F.struct(head.alias("header"), F.coalesce(let(same(head), lambda h: F.filter(lines, lambda v: same(v["text"]) != h)), lines).alias("lines"))


def _headed(captures: DataFrame, delimiter: str | None) -> DataFrame:
    below = let(F.col("lines"), lambda at: below_header(at, delimiter))
    return captures.withColumn("below", below).withColumn("header", F.col("below.header")).withColumn("lines", F.col("below.lines")).drop("below")


def _wrong_header(header: Column, columns: Sequence[str], delimiter: str | None, rename: Mapping[str, str], leading_label: str) -> Column:
    wrong = header.isNotNull() & F.coalesce(_head_names(header, delimiter, rename, leading_label) != F.array(*[F.lit(c) for c in columns]), F.lit(True))
    return F.when(wrong, F.lit("another header"))


def headed_value(lines: Column, columns: Sequence[str], delimiter: str | None, reader: LineReader) -> Column:
    """(rows, refusal) of a table below a header, of an array of lines: rows as the reader's structs."""
    told = lambda b: F.struct(F.transform(b["lines"], lambda v: reader.value(v["text"])).alias("rows"), _wrong_header(b["header"], columns, delimiter, {}, "").alias("refusal"))
    return let(let(lines, lambda at: below_header(at, delimiter)), told)


def headed_table(captures: DataFrame, rules: Mapping[str, Field] | None = None, *, columns: Sequence[str], delimiter: str | None = None, most: int | None = None, least: int | None = None, rename: Mapping[str, str] | None = None, leading_label: str = "", raw: bool = False) -> DataFrame:
    """A table whose first selected line is a header; ``columns`` are the keys
    that the header's names are normalised to, and another header is refused. A
    line equal to the header begins a second table."""
    heads = _headed(captures, delimiter)
    trouble = _wrong_header(F.col("header"), columns, delimiter, rename or {}, leading_label)
    heads = heads.withColumn("refusal", F.coalesce("refusal", trouble) if "refusal" in captures.columns else trouble)
    return table_rows(exploded(heads), columns, rules, delimiter=delimiter, most=most, least=least, raw=raw)


def alike(names: Column) -> Column:
    bad = F.exists(names, lambda n: n == "") | (F.size(F.array_distinct(names)) < F.size(names))
    return F.when(bad, F.lit("headings that are empty or alike"))


def map_reader(rules: Mapping[str, Field] | None, raw: bool = False) -> LineReader:
    """Steps from ``cells``, a map, ``trouble`` and ``unfit`` to the typed columns of the keys that have a rule."""
    keys = list({} if raw else rules or {})

    def asked(env: Mapping[str, Column]) -> dict[str, Column]:
        return {"unread": F.coalesce(env["trouble"], env["unfit"]), "value cells": env["cells"]} | {f"cell {k}": F.try_element_at(env["cells"], F.lit(k)) for k in keys}

    return LineReader([asked, *_typing(rules or {}, keys, raw)], ["cells", *keys])


def named_cells(rules: Mapping[str, Field] | None, raw: bool = False) -> LineReader:
    """Steps from ``names`` and ``cells``, arrays, and ``trouble`` to a map of them,
    ``value cells``, and the typed columns of the keys that have a rule."""
    keys = list({} if raw else rules or {})

    def made(env: Mapping[str, Column]) -> dict[str, Column]:
        cells = F.map_from_arrays(env["names"], let(env["cells"], lambda c: F.transform(env["names"], lambda _, k: F.get(c, k))))
        return {"unread": F.coalesce(env["trouble"], env["unfit"]), "value cells": F.when(env["trouble"].isNull(), cells)}

    def asked(env: Mapping[str, Column]) -> dict[str, Column]:
        return {f"cell {k}": F.try_element_at(env["value cells"], F.lit(k)) for k in keys} or {"no rule": F.lit(True)}

    return LineReader([made, asked, *_typing(rules or {}, keys, raw)], ["cells", *keys])


def derived_reader(rules: Mapping[str, Field] | None = None, *, delimiter: str | None = None, most: int | None = None, least: int | None = None, raw: bool = False) -> LineReader:
    """``named_cells`` of lines that are cut under ``names``."""
    inner = named_cells(rules, raw)

    def cut(env: Mapping[str, Column]) -> dict[str, Column]:
        width = F.lit(most) if most else F.size(env["names"])
        return {"cells": F.split(trimmed(env["line"]), f"{BLANK}+", width) if delimiter is None else F.transform(F.split(env["line"], literal(delimiter), width), trimmed)}

    def fits(env: Mapping[str, Column]) -> dict[str, Column]:
        size = F.size(env["cells"])
        return {"unfit": F.when(size > F.size(env["names"]), F.concat(F.lit("too many cells: "), env["line"])).when(size < (F.lit(least) if least else F.size(env["names"])), F.concat(F.lit("too few cells: "), env["line"]))}

    return LineReader([cut, fits, *inner.steps], inner.keys)


def derived_table(captures: DataFrame, rules: Mapping[str, Field] | None = None, *, delimiter: str | None = None, most: int | None = None, least: int | None = None, rename: Mapping[str, str] | None = None, leading_label: str = "", raw: bool = False) -> DataFrame:
    """A table whose keys are the names in its header line: each row is a map,
    and keys that have a rule are typed columns (null where the header doesn't
    name them). Names that are empty or alike are refused; shorter rows end in nulls."""
    heads = _headed(captures, delimiter).withColumn("names", _head_names(F.col("header"), delimiter, rename or {}, leading_label))
    trouble = alike(F.col("names"))
    heads = heads.withColumn("refusal", F.coalesce("refusal", trouble) if "refusal" in captures.columns else trouble)
    reader = derived_reader(rules, delimiter=delimiter, most=most, least=least, raw=raw)
    return reader.rows_of(exploded(heads, "names"), ("line", "names", "trouble"))


def derived_value(lines: Column, reader: LineReader, *, delimiter: str | None = None, rename: Mapping[str, str] | None = None, leading_label: str = "") -> Column:
    """(rows, refusal) of ``derived_table``, of an array of lines."""

    def told(b: Column) -> Column:
        def named(names: Column) -> Column:
            why = alike(names)
            each = lambda v: reader.value_of({"line": v["text"], "names": names, "trouble": why})
            return F.struct(F.transform(b["lines"], each).alias("rows"), why.alias("refusal"))

        return let(F.coalesce(_head_names(b["header"], delimiter, rename or {}, leading_label), F.array().cast("array<string>")), named)

    return let(let(lines, lambda at: below_header(at, delimiter)), told)


def _pairs(lines: Column, separator: str) -> Column:
    def pair(v: Column) -> Column:
        parts = F.split(v["text"], literal(separator), 2)
        return F.struct(v["num"].alias("num"), trimmed(F.get(parts, F.lit(0))).alias("name"), trimmed(F.get(parts, F.lit(1))).alias("value"))

    return F.transform(lines, pair)


def _pair_refusal(pairs: Column) -> Column:
    def again(p: Column) -> Column:
        first = F.get(F.filter(pairs, lambda q: (q["name"] == p["name"]) & (q["num"] < p["num"])), F.lit(0))["num"]
        return F.concat(F.lit("a key twice, at lines "), first.cast("string"), F.lit(" and "), p["num"].cast("string"))

    def judged(names: Column) -> Column:
        second = F.get(F.filter(pairs, lambda p: F.array_position(names, p["name"]) < F.array_position(F.transform(pairs, lambda q: q["num"]), p["num"])), F.lit(0))
        return F.when(F.size(F.array_distinct(names)) < F.size(names), let(second, again))

    bad = F.filter(pairs, lambda p: p["value"].isNull() | (p["name"] == ""))
    torn = let(bad, lambda b: F.when(F.size(b) > 0, F.concat(F.lit("no pair at line "), F.get(b, F.lit(0))["num"].cast("string"))))
    return F.coalesce(torn, let(F.transform(pairs, lambda p: p["name"]), judged))


def _ruled(pairs: Column, rules: Mapping[str, Field]) -> Column:
    """Pairs with the text of the typed value, and why, for the names that have a rule."""

    def one(p: Column) -> Column:
        value, why = p["value"], F.lit(None).cast("string")
        for key, rule in rules.items():
            got, reason = compiled(p["value"], rule, key)
            value = F.when(p["name"] == key, got.cast("string")).otherwise(value)
            why = F.when(p["name"] == key, reason).otherwise(why)
        return F.struct(p["num"].alias("num"), p["name"].alias("name"), value.alias("value"), why.alias("why"))

    return F.transform(pairs, one)


def map_value(lines: Column, separator: str, rules: Mapping[str, Field]) -> Column:
    """(pairs, refusal) of an array of lines."""

    def told(pairs: Column) -> Column:
        why = _pair_refusal(pairs)
        if rules:
            named = F.transform(pairs, lambda p: p["name"])
            absent = [F.when(~F.array_contains(named, k), F.lit(f"{k}: required")) for k, r in rules.items() if r.required]
            why = F.coalesce(why, F.get(F.array_compact(F.transform(pairs, lambda p: p["why"])), F.lit(0)), *absent)
        made = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["name"], p["value"])))
        return let(why, lambda w: F.struct(F.when(w.isNull(), made).alias("pairs"), w.alias("refusal")))

    return let(_ruled(_pairs(lines, separator), rules) if rules else _pairs(lines, separator), told)


def _as_map(df: DataFrame, keep: Sequence[str], separator: str, rules: Mapping[str, Field]) -> DataFrame:
    """``keep``, pairs and refusal of captures (lines, refusal)."""
    df = df.withColumn("made", map_value(F.col("lines"), separator, rules))
    refusal = F.coalesce("refusal", "made.refusal")
    return df.select(*keep, F.when(refusal.isNull(), F.col("made.pairs")).alias("pairs"), held(refusal).alias("refusal"))


def _with_refusal(captures: DataFrame) -> DataFrame:
    return captures if "refusal" in captures.columns else captures.withColumn("refusal", F.lit(None).cast("string"))


def kv_map(captures: DataFrame, separator: str = "=", rules: Mapping[str, Field] | None = None) -> DataFrame:
    """One map for a capture; a key that comes twice is refused. A value whose
    key has a rule is the typed value's text."""
    return _as_map(_with_refusal(captures), ["capture_id"], separator, rules or {})


def _sections(lines: Column) -> Column:
    """(section, lines) of the blocks of an INI text, in order; a section may have several."""
    heading = r"\A\p{IsWhite_Space}*\[(.*)\]\p{IsWhite_Space}*\z"

    def section(block: Column) -> Column:
        first = F.get(block, F.lit(0))["text"]
        named = F.coalesce(first.rlike(heading), F.lit(False))
        return F.struct(F.when(named, trimmed(F.regexp_extract(first, heading, 1))).otherwise("").alias("section"), named.alias("named"), F.when(named, F.slice(block, 2, F.size(block))).otherwise(block).alias("lines"))

    def cut(all_: Column) -> Column:
        starts = F.array_distinct(F.concat(F.array(F.lit(1)), indexes(all_, lambda t: t.rlike(heading))))
        return F.filter(F.transform(blocks(all_, starts), section), lambda b: b["named"] | (F.size(b["lines"]) > 0))

    return let(F.filter(lines, lambda v: ~v["text"].rlike(rf"\A{BLANK}*[#;]")), cut)


def _section_names(blocks_: Column) -> Column:
    return F.array_distinct(F.transform(blocks_, lambda b: b["section"]))


def _section_lines(blocks_: Column, name: Column) -> Column:
    return F.flatten(F.transform(F.filter(blocks_, lambda b: b["section"] == name), lambda b: b["lines"]))


def ini_sections(captures: DataFrame, separator: str = "=", rules: Mapping[str, Field] | None = None) -> DataFrame:
    """A row for each section of a capture: section and its pairs. Pairs before
    the first heading are section ``''``; a section may resume; comments begin
    with ``#`` or ``;``. A key twice in a section is refused."""
    df = _with_refusal(captures).withColumn("blocks", _sections(F.col("lines")))
    df = df.select("capture_id", "refusal", "blocks", F.explode(F.when(F.col("refusal").isNotNull(), F.array(F.lit(""))).otherwise(_section_names(F.col("blocks")))).alias("section"))
    df = df.withColumn("lines", let(F.col("section"), lambda n: _section_lines(F.col("blocks"), n)))
    return _as_map(df, ["capture_id", "section"], separator, rules or {})


def ini_value(lines: Column, separator: str, rules: Mapping[str, Field]) -> Column:
    """(sections, refusal) of an array of lines: section and pairs of each."""

    def told(blocks_: Column) -> Column:
        def one(n: Column) -> Column:
            return let(map_value(_section_lines(blocks_, n), separator, rules), lambda m: F.struct(n.alias("section"), m["pairs"].alias("pairs"), m["refusal"].alias("why")))

        return F.transform(_section_names(blocks_), one)

    def split(found: Column) -> Column:
        why = F.get(F.array_compact(F.transform(found, lambda x: x["why"])), F.lit(0))
        return F.struct(F.transform(found, lambda x: F.struct(x["section"], x["pairs"])).alias("sections"), why.alias("refusal"))

    return let(let(_sections(lines), told), split)


def _tree(lines: Column, indent: str | Sequence[str], root: str) -> Column:
    """An array of (num, depth, text, why) of a tree's lines."""
    units = [indent] if isinstance(indent, str) else list(indent)
    one = "(?>" + "|".join(map(literal, units)) + ")"  # the first stated that fits
    # a branch, which ends in no blank, ends the indentation
    lead_ = rf"\A(?:{one}(?<=[ \t]))*+{one}?+"

    def node(v: Column) -> Column:
        lead = F.regexp_extract(v["text"], lead_, 0)
        rest = F.substring(v["text"], F.length(lead) + 1, F.length(v["text"]))
        return F.struct(v["num"].alias("num"), F.size(F.regexp_extract_all(lead, F.lit(f"({one})"), F.lit(1))).alias("depth"), rest.alias("text"), (lead.rlike(r"[^ \t]\z")).alias("branched"))

    def judged(v: Column) -> Column:
        why = F.when(~v["branched"] & v["text"].rlike(r"\A[ \t]"), F.lit("part of an indent")).when(v["depth"] > MOST_LEVELS, F.lit(f"over {MOST_LEVELS} levels"))
        if root:
            why = F.coalesce(why, F.when((v["depth"] == 0) & ~translate(root).matches(v["text"]), F.lit("a line at the top level that isn't a root")))
        return F.struct(v["num"], v["depth"], v["text"], why.alias("why"))

    return F.transform(F.transform(lines, node), judged)


def _skipped(depth: Column, parent: Column) -> Column:
    return F.when((depth > 0) & (F.coalesce(parent, F.lit(0)) == 0), F.lit("a skipped level"))


def tree_nodes(captures: DataFrame, indent: str | Sequence[str] = "  ", *, root: str = "", reader: LineReader | None = None) -> DataFrame:
    """A row for each line: its depth by units of ``indent``, and the line of its
    parent. A skipped level, part of a unit, or over 32 levels is refused.

    Several units may be given, as drawn trees have (``|  ``, ``   ``, and ``|-``
    or ``+- ``): at each step the first that fits is a level, and one that ends in
    no blank ends the indentation, whatever blanks follow it. With ``root``, a line of
    depth 0 that doesn't match it is refused. With a ``reader``, its keys stand
    in place of the text.

    The parent is the last line above that is one level higher: the number of
    the last line of each level is carried down the capture.
    """
    df = _with_refusal(captures).withColumn("nodes", _tree(F.col("lines"), indent, root)).withColumn("parents", let(F.col("nodes"), _parents))
    none = F.struct(F.lit(0).alias("num"), F.lit(0).alias("depth"), F.lit("").alias("text"), F.lit(None).cast("string").alias("why"))
    troubled = F.array(F.struct(none.alias("nodes"), F.lit(0).alias("parents")))
    rows = df.select("capture_id", F.col("refusal").alias("trouble"), F.inline(F.when(F.col("refusal").isNotNull(), troubled).otherwise(F.arrays_zip("nodes", "parents"))))
    depth = F.col("nodes.depth")
    own = F.coalesce("trouble", "nodes.why", _skipped(depth, F.col("parents")))
    told = rows.select("capture_id", F.col("nodes.num").alias("num"), depth.alias("depth"), F.when(depth > 0, F.col("parents")).alias("parent"), F.col("nodes.text").alias("text"), held(own).alias("trouble"))
    if reader is None:
        return told.withColumnRenamed("trouble", "refusal")
    return reader.rows(told, ("capture_id", "num", "depth", "parent"), "text")


def tree_value(lines: Column, indent: str | Sequence[str] = "  ", *, root: str = "", reader: LineReader | None = None, member: Callable[[Column, str], Column] | None = None) -> Column:
    """(json, refusal) of a tree as one nested value: each node has its keys and
    ``children``, a list that may be empty. ``member`` writes a node's key as JSON;
    keys are those of its alternative, in that one's order.

    The lines are the nodes in the order in which JSON has them, so each adds its
    own opening, and closes what the next one's depth tells is over: one pass,
    and no value is built from another.
    """

    def text_of(nodes: Column, values: Column) -> Column:
        def opened(k: Column) -> Column:
            value = F.get(values, k)
            body = None
            for number, names in enumerate(reader.alternatives or [reader.keys]):
                members = F.array_join(F.array(*[F.concat(member(F.lit(key), ""), F.lit(":"), member(value[key], key)) for key in names]), ",")
                body = F.when(value["which"] == number, members) if body is None else body.when(value["which"] == number, members)
            return F.concat(F.lit("{"), body, F.lit(',"children":['))

        def one(v: Column, k: Column) -> Column:
            over = v["depth"] - F.coalesce(F.get(nodes, k + 1)["depth"], F.lit(0)) + 1  # this node, and those above that end with it
            last = k + 1 == F.size(nodes)
            return F.concat(opened(k), F.repeat(F.lit("]}"), F.greatest(over, F.lit(0))), F.when(last | (over <= 0), "").otherwise(","))

        return F.concat(F.lit("["), F.array_join(F.transform(nodes, one), ""), F.lit("]"))

    def whole(nodes: Column) -> Column:
        values = reader.values(F.transform(nodes, lambda v: v["text"]))
        return F.struct(nodes.alias("nodes"), values.alias("values"), _parents(nodes).alias("parents"))

    def told(t: Column) -> Column:
        skipped = F.zip_with(t["nodes"], t["parents"], lambda v, above: F.coalesce(v["why"], _skipped(v["depth"], above)))
        unread = F.transform(t["values"], lambda v: v["refusal"])
        why = F.get(F.array_compact(F.zip_with(skipped, unread, lambda a, b: F.coalesce(a, b))), F.lit(0))
        return F.struct(F.when(why.isNull(), text_of(t["nodes"], t["values"])).alias("json"), why.alias("refusal"))

    return let(let(_tree(lines, indent, root), whole), told)


def _parents(nodes: Column) -> Column:
    """For each node (num, depth) the line of its parent, 0 where there is none."""
    levels = F.transform(F.sequence(F.lit(0), F.lit(MOST_LEVELS)), lambda _: F.lit(0))

    def step(a: Column, v: Column) -> Column:
        above = F.when(v["depth"] > 0, F.get(a["last"], v["depth"] - 1)).otherwise(0)
        last = F.transform(a["last"], lambda x, k: F.when(k == v["depth"], v["num"]).when(k > v["depth"], 0).otherwise(x))
        return F.struct(last.alias("last"), F.concat(a["parents"], F.array(above)).alias("parents"))

    def block(a: Column, at: Column) -> Column:
        # what is appended to stays short: the parents of one block of lines
        start = F.struct(a["last"].alias("last"), F.array().cast("array<int>").alias("parents"))
        return let(F.aggregate(F.slice(nodes, at, TREE_BLOCK), start, step), lambda b: F.struct(b["last"].alias("last"), F.concat(a["blocks"], F.array(b["parents"])).alias("blocks")))

    start = F.struct(levels.alias("last"), F.array().cast("array<array<int>>").alias("blocks"))
    begins = F.when(F.size(nodes) > 0, F.sequence(F.lit(1), F.size(nodes), F.lit(TREE_BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(begins, start, block)["blocks"])


def record_blocks(captures: DataFrame, start: str) -> DataFrame:
    """A row for each block of lines that begins at a match of ``start``:
    capture_id (as it was), record (from 1), lines. Lines before the first are
    refused."""
    df = _with_refusal(captures).withColumn("starts", indexes(F.col("lines"), translate(start).matches))
    early = (F.size("lines") > 0) & (F.coalesce(F.get("starts", F.lit(0)), F.lit(0)) != 1)
    df = df.withColumn("refusal", F.coalesce("refusal", F.when(early, F.lit("text before the first record"))))
    # held: else a filter on their number computes them again, twice over, below the rows that they give
    df = df.withColumn("blocks", held(F.when(F.col("refusal").isNull(), blocks(F.col("lines"), F.col("starts"))).otherwise(F.array(F.col("lines")))))
    return df.select("capture_id", "refusal", F.posexplode("blocks").alias("record", "lines")).withColumn("record", F.col("record") + 1)


def unread(prepared_lines: DataFrame, *readers: DataFrame) -> DataFrame:
    """Lines (capture_id, num, line) that aren't blank and that no reader has
    read, for texts that are tables of lines; ``Shape`` tells it of captures by itself."""
    read = readers[0].select("capture_id", "num")
    for r in readers[1:]:
        read = read.unionByName(r.select("capture_id", "num"))
    return prepared_lines.filter(~is_blank(F.col("line"))).join(read.distinct(), ["capture_id", "num"], "left_anti")


def settle_refusals(rows: DataFrame, mode: str = "fail") -> DataFrame:
    """``fail``: the first refusal met ends the query, even if no column that it
    is about is selected later. ``report``: refusals stay as a column."""
    if mode == "report":
        return rows
    fine = F.when(F.col("refusal").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("refusal")).cast("boolean"))
    return rows.filter(fine).drop("refusal")
