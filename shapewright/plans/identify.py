"""Which registered shape describes a capture.

The catalog is a DataFrame of definitions, one row each: parser, variant, source
(an earlier one wins), priority, os, explicit_only, window, and patterns all,
any and none. Layering, disabling and tie-breaking are joins and windows on it.
A capture is matched by expressions made of literal patterns, one flag for each
definition, so every pattern is compiled once for a task and no pair of capture
and definition is made but those that match. The first lines are cut out once
for each length of window; before a pattern is tried, the text that every match
of it holds is looked for. Candidates are settled inside the capture's row, so
identifying shuffles nothing.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import translate
from ..functions.steps import held
from ..functions.text import BLANK, let
from ..operators.workers import reach_workers
from ..sources.readers import evidence
from .choice import fitting

#: Lines of a signature's window.
WINDOW, MOST_WINDOW = 20, 200
#: Definitions from which on texts are told apart by what their patterns require, many at a time.
MANY = 32


@dataclass(frozen=True)
class Signature:
    """A definition as the catalog holds it."""

    parser: str
    variant: str
    source: int = 0
    priority: int = 0
    os: tuple[str, ...] = ()
    explicit_only: bool = False
    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    window: int = WINDOW
    aliases: tuple[str, ...] = ()
    args_any: tuple[str, ...] = ()
    args_all: tuple[str, ...] = ()
    args_none: tuple[str, ...] = ()
    #: Of aliases with arguments of their own: (alias, {any, all, none}).
    alias_args: tuple[tuple[str, Mapping[str, Sequence[str]]], ...] = ()


def catalog(spark: SparkSession, signatures: Sequence[Signature]) -> DataFrame:
    rows = [(s.parser, s.variant, s.source, s.priority, list(s.os), s.explicit_only, list(s.all), list(s.any), list(s.none), s.window) for s in signatures]
    return spark.createDataFrame(rows, "parser string, variant string, source int, priority int, os array<string>, explicit_only boolean, all array<string>, any array<string>, none array<string>, window int")


def layered(definitions: DataFrame) -> DataFrame:
    """Of definitions of one name, that of the earliest source."""
    first = Window.partitionBy("parser", "variant").orderBy("source")
    return definitions.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def without_disabled(definitions: DataFrame, disabled: DataFrame) -> DataFrame:
    """Without what a source (``disabled``: parser, variant or null for all,
    source) disables in the sources after it."""
    d = disabled.select(F.col("parser").alias("dp"), F.col("variant").alias("dv"), F.col("source").alias("ds"))
    hit = (F.col("parser") == F.col("dp")) & (F.col("dv").isNull() | (F.col("variant") == F.col("dv"))) & (F.col("source") > F.col("ds"))
    return definitions.join(d, hit, "left_anti")


def window_text(text: Column, lines: int) -> Column:
    """The first lines from the first that isn't blank, joined by newlines."""
    lines = min(lines, MOST_WINDOW)
    # no more of a text is cut up than a window takes: blank lines first, then its own
    bare = F.regexp_replace(text, rf"\A(?:{BLANK}*\n)?", "")

    def shown(parts: Column) -> Column:
        return F.array_join(F.transform(F.slice(parts, 1, lines), lambda t: F.regexp_replace(t, r"\r\z", "")), "\n")

    return F.regexp_replace(let(F.split(bare, "\n", lines + 1), shown), r"\n+\z", "")


def windows(captures: DataFrame, signatures: Sequence[Signature]) -> DataFrame:
    """``captures`` with ``window <n>`` for each length that a signature asks for."""
    return captures.withColumns({f"window {n}": held(window_text(F.col("text"), n)) for n in sorted({s.window for s in signatures})})


@cache
def required_text(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern holds;
    empty if none is told at sight."""
    if "|" in pattern or pattern.startswith("(?i"):
        return ""
    best = run = ""
    at, depth = 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            c, at = pattern[at : at + 2], at + 1
        elif c == "[":
            end = at + 1
            while end < len(pattern) and (pattern[end] != "]" or end <= at + 1 + pattern.startswith("[^", at)):
                end += 1 + (pattern[end] == "\\")
            c, at = "[]", end
        depth += (c == "(") - (c == ")")
        following = pattern[at + 1 : at + 2]
        plain = c[-1] if len(c) == 2 and c[0] == "\\" and not c[1].isalnum() else c if len(c) == 1 and c not in ".^$()*+?{}[]" else ""
        if plain and not depth and following not in ("*", "?", "{"):
            run += plain
            if following == "+":
                best, run = max(best, run, key=len), ""
        else:
            best, run = max(best, run, key=len), ""
            if c == "{":
                at = pattern.find("}", at)
        at += 1
    return max(best, run, key=len)


def matches(shown: Column, s: Signature) -> Column:
    """All of the one kind, one of the other if there are any, none of the third."""

    def hit(p: str) -> Column:
        found = translate("(?m)" + p if not p.startswith("(?") else p).matches(shown)
        needed = required_text(p)
        return shown.contains(needed) & found if len(needed) > 1 else found

    found = F.lit(True)
    for p in s.all:
        found = found & hit(p)
    if s.any:
        one = F.lit(False)
        for p in s.any:
            one = one | hit(p)
        found = found & one
    for p in s.none:
        found = found & ~hit(p)
    return found


def _fits(s: Signature) -> Column:
    return matches(F.col(f"`window {s.window}`"), s)


def holds_argument(args: Column, wanted: str) -> Column:
    """Whether a command's arguments hold one: as written, as a letter of bundled
    ones (as often, all in all, as it is wanted), or, ending in ``=``, with any
    value. What follows ``--`` are operands and says nothing."""
    end = F.array_position(args, "--")
    options = F.when(end > 0, F.slice(args, F.lit(1), (end - 1).cast("int"))).otherwise(args)
    found = F.array_contains(options, wanted)
    if wanted.startswith("-") and wanted.endswith("=") and len(wanted) > 2:
        found = found | F.exists(options, lambda a: F.startswith(a, F.lit(wanted)))
    letters = wanted[1:]
    if wanted.startswith("-") and letters and letters[0] != "-" and len(set(letters)) == 1:
        bundles = F.filter(options, lambda a: a.rlike(r"\A-[^-]"))
        times = F.aggregate(bundles, F.lit(0), lambda n, a: n + F.length(a) - F.length(F.replace(a, F.lit(letters[0]), F.lit(""))))
        found = found | (times >= len(letters))
    return found


def against(captures: DataFrame, s: Signature, named: str | None = None) -> Column:
    """Why a definition whose text may match isn't for a capture: another system
    (column os, null if not known), or its arguments (column args); null if it is.
    A definition that is named by an alias with arguments of its own has those."""
    own = dict(s.alias_args).get(named) if named else None
    if own is not None:
        s = replace(s, args_any=tuple(own.get("any", ())), args_all=tuple(own.get("all", ())), args_none=tuple(own.get("none", ())))
    reasons = [F.lit(None).cast("string")]
    if s.os and "os" in captures.columns:
        reasons.append(F.when(~F.col("os").isin(list(s.os)), F.lit(f"only for {', '.join(s.os)}")))
    if "args" in captures.columns:
        args = F.coalesce("args", F.array().cast("array<string>"))
        if s.args_any:
            one = F.lit(False)
            for a in s.args_any:
                one = one | holds_argument(args, a)
            reasons.append(F.when(~one, F.lit(f"needs one of the arguments {', '.join(s.args_any)}")))
        reasons += [F.when(~holds_argument(args, a), F.lit(f"needs the argument {a}")) for a in s.args_all]
        reasons += [F.when(holds_argument(args, a), F.lit(f"excluded by the argument {a}")) for a in s.args_none]
    return F.coalesce(*reasons) if len(reasons) > 1 else reasons[0]


def _open(signatures: Sequence[Signature], named: str | None, variant: str | None = None) -> list[Signature]:
    """Definitions to choose from: those of the name or alias (and variant) that
    is named, or all that need no naming. A definition that any text fits, under
    a command whose others have a signature, is meant only by its variant."""
    if not named:
        return [s for s in signatures if not s.explicit_only]
    own = [s for s in signatures if named in (s.parser, *s.aliases) and variant in (None, s.variant)]
    bare = [s for s in own if s.explicit_only and not (s.all or s.any or s.none)]
    return own if variant or len(bare) == len(own) else [s for s in own if s not in bare]


def _told(s: Signature, **more: Column) -> Column:
    return F.struct(F.lit(s.parser).alias("parser"), F.lit(s.variant).alias("variant"), F.lit(s.source).alias("source"), *[c.alias(n) for n, c in more.items()])


def _flagged(captures: DataFrame, signatures: Sequence[Signature], flags) -> DataFrame:
    """``captures`` with found: those of ``flags`` of each signature that aren't null."""
    if not signatures:
        raise ValueError("no definition to choose from")
    df = windows(captures, signatures)
    return df.withColumn("found", F.array_compact(F.array(*[flags(s) for s in signatures])))


def near_misses(captures: DataFrame, signatures: Sequence[Signature], *, named: str | None = None, variant: str | None = None) -> DataFrame:
    """(capture_id, parser, variant, source, reason): definitions whose text
    matches but which system or arguments rule out, and named ones whose text doesn't."""

    open_ = _open(signatures, named, variant)
    return _flagged(captures, open_, lambda s: _missed(captures, s, named)).select("capture_id", F.inline("found"))


def _missed(captures: DataFrame, s: Signature, named: str | None) -> Column:
    """What rules a definition out, if its text matches or it is named."""
    fits = _fits(s)
    why = F.when(fits, against(captures, s, named))
    if named:
        why = why.when(~fits, F.lit("the text doesn't match"))
    return let(why, lambda w: F.when(w.isNotNull(), _told(s, reason=w)))


def _candidates(captures: DataFrame, signatures: Sequence[Signature], named: str | None, variant: str | None, text: bool = True) -> DataFrame:
    """``captures`` with found: the definitions that fit, read off a constant by their numbers."""
    open_ = _open(signatures, named, variant)
    told = json.dumps([{"parser": s.parser, "variant": s.variant, "source": s.source, "priority": s.priority} for s in open_])
    known = F.from_json(F.lit(told), "array<struct<parser:string,variant:string,source:int,priority:int>>")
    numbers = {id(s): k for k, s in enumerate(open_)}

    limited = lambda s: s.os or s.args_any or s.args_all or s.args_none or s.alias_args
    read = lambda df: df.withColumn("found", F.transform("found", lambda k: F.get(known, k)))
    if text and (len(open_) > MANY or any(translate(p).deep for s in open_ for p in (*s.all, *s.any, *s.none))):
        df = windows(captures, open_)
        out = F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(against(captures, s, named).isNotNull(), F.lit(k)) for k, s in enumerate(open_) if limited(s)]))
        return read(df.withColumn("found", F.array_except(_fitting(captures.sparkSession, open_), out)))

    def hit(s: Signature) -> Column:
        fits = _fits(s) if text else F.lit(True)
        return F.when(fits & against(captures, s, named).isNull() if limited(s) else fits, F.lit(numbers[id(s)]))

    return read(_flagged(captures, open_, hit))


def _fitting(spark: SparkSession, signatures: Sequence[Signature]) -> Column:
    """The numbers of the signatures that fit the windows, of a batch of texts at a time."""
    lengths = sorted({s.window for s in signatures})
    asked = [(s.window, s.all, s.any, s.none) for s in signatures]
    reach_workers(spark)

    @F.arrow_udf("array<int>")
    def found(*texts: pa.Array) -> pa.Array:
        cut = {n: pc.fill_null(t, "") for n, t in zip(lengths, texts, strict=True)}
        fits = fitting(cut, asked, required_text)
        return pa.array([None if null else f for f, null in zip(fits, texts[0].is_null().to_pylist(), strict=True)], pa.list_(pa.int32()))

    return F.coalesce(found(*[F.col(f"`window {n}`") for n in lengths]), F.array().cast("array<int>"))


def candidates(captures: DataFrame, signatures: Sequence[Signature], *, named: str | None = None, variant: str | None = None) -> DataFrame:
    """(capture_id, parser, variant, source, priority) of signatures that match.
    Ones that need naming are left out unless ``named``."""
    return _candidates(captures, signatures, named, variant).select("capture_id", F.inline("found"))


def candidates_without_text(captures: DataFrame, signatures: Sequence[Signature], *, named: str | None = None) -> DataFrame:
    """The same by system and arguments alone, for commands that printed nothing."""
    blank = captures.withColumn("text", F.lit(""))
    return _candidates(blank, signatures, named, None, text=False).select("capture_id", F.inline("found"))


def identified(captures: DataFrame, signatures: Sequence[Signature], *, named: str | None = None, variant: str | None = None) -> DataFrame:
    """(capture_id, parser, variant, refusal): of several candidates those of the
    earliest source count; if they are of one parser, the one of strictly
    highest priority. Otherwise the capture is ambiguous, and it is refused.

    Where ``captures`` have a ``path`` and nothing is named, one that suggests a
    definition that the text fits decides; where it doesn't fit, the path says nothing."""
    return _settled(_candidates(captures, signatures, named, variant), named).select("capture_id", "parser", "variant", "refusal")


def explained(captures: DataFrame, signatures: Sequence[Signature], *, named: str | None = None, variant: str | None = None) -> DataFrame:
    """(capture_id, parser, variant, refusal, candidates, rejected): the choice, the
    definitions it was made from, best first, and those that something other than
    the text rules out, with the reason. All of it is told in the capture's row."""
    df = _settled(_candidates(captures, signatures, named, variant), named)
    rejected = F.array_compact(F.array(*[_missed(captures, s, named) for s in _open(signatures, named, variant)]))
    names = F.transform("ranked", lambda c: F.concat_ws("/", c["parser"], c["variant"]))
    told = F.transform(rejected, lambda r: F.concat(r["parser"], F.lit("/"), r["variant"], F.lit(": "), r["reason"]))
    return df.select("capture_id", "parser", "variant", "refusal", names.alias("candidates"), told.alias("rejected"))


def _settled(df: DataFrame, named: str | None) -> DataFrame:
    """``df`` with the choice among found."""
    least = F.array_min(F.transform("found", lambda c: c["source"]))
    first = let(least, lambda n: F.filter("found", lambda c: c["source"] == n))
    if "path" in df.columns and not named:
        parser, at = evidence(F.col("path"))
        meant = F.filter("found", lambda c: (c["parser"] == parser) & (c["variant"] == at))
        first = F.when(F.size(meant) > 0, F.slice(meant, 1, 1)).otherwise(first)
    df = df.withColumn("first", first)
    # highest priority first; the row is small, whatever the capture's size
    ranked = F.reverse(F.array_sort(F.transform("first", lambda c: F.struct(c["priority"].alias("priority"), c["parser"].alias("parser"), c["variant"].alias("variant")))))
    df = df.withColumn("ranked", ranked)
    best, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    alone = F.size(F.array_distinct(F.transform("ranked", lambda c: c["parser"]))) == 1
    clear = (F.size("ranked") == 1) | ((F.size("ranked") > 1) & alone & (best["priority"] > second["priority"]))
    names = F.array_join(F.array_sort(F.transform("ranked", lambda c: F.concat_ws("/", c["parser"], c["variant"]))), ", ")
    refusal = F.when(F.size("ranked") == 0, F.lit("no definition matches")).when(~clear, F.concat(F.lit("ambiguous: "), names))
    return df.withColumns({"parser": F.when(clear, best["parser"]), "variant": F.when(clear, best["variant"]), "refusal": refusal})


def lookup(definitions: DataFrame, *, parser: str | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Definitions of a command by its name or by one of its ``aliases`` (alias,
    parser), in the order of their names; without one, all of them."""
    df = definitions
    if parser is not None:
        named = F.col("parser") == parser
        if aliases is not None:
            own = aliases.filter(F.col("alias") == parser).select(F.col("parser").alias("meant")).distinct()
            df = df.join(own, df["parser"] == own["meant"], "left")
            named = named | F.col("meant").isNotNull()
        df = df.filter(named).drop("meant")
    return df.orderBy("parser", "variant")


def commands(definitions: DataFrame) -> DataFrame:
    """(parser, n_variants, variants) of each command."""
    return definitions.groupBy("parser").agg(F.countDistinct("variant").alias("n_variants"), F.array_sort(F.collect_set("variant")).alias("variants"))


def suggested(spark: SparkSession, name: str, known: DataFrame) -> DataFrame:
    """Up to three names nearest to a mistaken one: within two edits, or that it begins."""
    far = known.select("parser").distinct().withColumn("edits", F.when(F.startswith("parser", F.lit(name)), 0).otherwise(F.levenshtein("parser", F.lit(name)))).filter("edits <= 2")
    best = Window.orderBy("edits")  # over names within two edits
    return far.withColumn("nth", F.rank().over(best)).filter("nth = 1").orderBy("parser").limit(3).select("parser")
