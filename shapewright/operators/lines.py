"""Lines of a capture and the regions of them that are read.

A capture (one row: capture_id and text, of at most MOST_BYTES) keeps its lines
in one array of (num, text). All steps here are functions of that array, so they
need no shuffle, and a line keeps its number. Only what is parsed line by line is
then exploded. Texts that are tables of lines already, without a bound, use the
line-level operators of ``parse`` directly.

Every line is read or left out by a rule: what a region neither selects nor
names as blank, ignored, its heading or its end is unread, and its capture is
refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_of, covered_by, translate
from ..functions.steps import held
from ..functions.text import WHITE, is_blank, let, literal, trimmed, without_escapes

#: Limits of one capture, one record, and of values that one capture gives.
MOST_BYTES = 64 << 20
MOST_RECORD_BYTES = 1 << 20
MOST_VALUES = 4_194_304
#: Unread lines that a refusal quotes.
MOST_TOLD = 3


@dataclass(frozen=True)
class Region:
    """Which lines are read: fold, drop and select, in this order."""

    separator: str = "\n"
    strip_ansi: bool = False
    fold: str = ""
    skip_blank: bool = True
    ignore: tuple[str, ...] = ()
    after: str = ""
    until: str = ""
    skip: int = 0
    limit: int | None = None

    @property
    def selects(self) -> bool:
        return bool(self.after or self.until or self.skip or self.limit is not None)


def split_records(text: Column, separator: str = "\n") -> Column:
    """Array of (num, text); a separator at the end ends the last record."""

    def cut(parts: Column) -> Column:
        ended = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
        return F.transform(ended, lambda v, k: F.struct((k + 1).alias("num"), v.alias("text")))

    return let(F.split(text, separator if len(separator) == 1 and separator not in ".$|()[{^?*+\\" else literal(separator), -1), cut)


def prepared(lines: Column, region: Region, *, verbatim: bool = False) -> Column:
    """Escapes first, then a carriage return at the end, then the first line's BOM;
    ``verbatim`` lines keep these two."""
    if verbatim and not region.strip_ansi:
        return lines

    def one(line: Column) -> Column:
        text = without_escapes(line["text"]) if region.strip_ansi else line["text"]
        if region.separator == "\n" and not verbatim:
            text = F.when(F.endswith(text, F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
        if not verbatim:
            text = F.when((line["num"] == 1) & F.startswith(text, F.lit("﻿")), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
        return F.struct(line["num"].alias("num"), text.alias("text"))

    return F.transform(lines, one)


def blocks(lines: Column, starts: Column) -> Column:
    """Slices of ``lines`` from each index (from 1, ascending) to before the next."""
    return let(lines, lambda all_: let(starts, lambda s: F.transform(s, lambda at, k: F.slice(all_, at, F.coalesce(F.get(s, k + 1), F.size(all_) + 1) - at))))


def indexes(lines: Column, predicate) -> Column:
    """Indexes, from 1, of the lines that the predicate on their text holds for."""
    marked = F.transform(lines, lambda v, k: F.when(predicate(v["text"]), k + 1))
    return F.array_compact(marked)


def folded(lines: Column, pattern: str) -> Column:
    """Lines that match are joined to the one above by a space, trimmed."""
    continues = translate(pattern)
    starts = indexes(lines, lambda t: ~continues.matches(t))

    def join(block: Column) -> Column:
        first = F.get(block, F.lit(0))
        joined = F.array_join(F.transform(block, lambda v: trimmed(v["text"])), " ")
        return F.struct(first["num"].alias("num"), F.when(F.size(block) == 1, first["text"]).otherwise(joined).alias("text"))

    return F.transform(blocks(lines, starts), join)


def fold_refusal(lines: Column, pattern: str, white: str = WHITE) -> Column:
    """Why folding is refused: nothing, or a blank line, above a continuation."""
    continues = translate(pattern)
    bad = let(lines, lambda all_: F.filter(all_, lambda v, k: continues.matches(v["text"]) & (F.get(all_, k - 1).isNull() | is_blank(F.get(all_, k - 1)["text"], white))))
    return let(bad, lambda b: F.when(F.size(b) > 0, F.concat(F.lit("nothing to fold into at line "), F.get(b, F.lit(0))["num"].cast("string"))))


def without_edge_blanks(lines: Column, skip_blank: bool, white: str = WHITE) -> Column:
    """Without blank (if blanks are kept, only empty) lines at either end."""
    full = indexes(lines, lambda t: ~is_blank(t, white)) if skip_blank else indexes(lines, lambda t: t != "")
    empty = F.filter(lines, lambda v: F.lit(False))
    return let(full, lambda f: F.when(F.size(f) == 0, empty).otherwise(F.slice(lines, F.get(f, F.lit(0)), F.element_at(f, -1) - F.get(f, F.lit(0)) + 1)))


def dropped(lines: Column, region: Region) -> Column:
    """Without blank lines, unless they count, and without ignored ones."""
    stay = F.filter(lines, lambda v: ~is_blank(v["text"])) if region.skip_blank else lines
    if region.ignore:
        stay = F.filter(stay, lambda v: ~any_of(v["text"], list(region.ignore)))
    return stay


def bounds(lines: Column, region: Region) -> Column:
    """(heading, low, high, end): the index of the line that ``after`` matches (0
    without one), the first and last index selected, and the index of the line
    that ``until`` matches. Where nothing matches ``after``, nothing is selected."""
    size = F.size(lines)
    heading = F.coalesce(F.get(indexes(lines, translate(region.after).matches), F.lit(0)), size + 1) if region.after else F.lit(0)

    def inside(h: Column) -> Column:
        end = size + 1
        if region.until:
            end = F.coalesce(F.get(F.filter(indexes(lines, translate(region.until).matches), lambda k: k > h), F.lit(0)), size + 1)
        low = h + 1 + region.skip
        return let(end, lambda e: F.struct(h.alias("heading"), F.least(low, size + 1).alias("low"), (F.least(e - 1, low + region.limit - 1) if region.limit is not None else e - 1).alias("high"), e.alias("end")))

    return let(heading, inside)


def selected(lines: Column, region: Region) -> Column:
    """From after the first match of ``after`` to before the next of ``until``;
    then ``skip`` lines less, then at most ``limit``."""
    if not region.selects:
        return lines
    return let(bounds(lines, region), lambda b: F.slice(lines, b["low"], F.greatest(b["high"] - b["low"] + 1, F.lit(0))))


def read_by(lines: Column, region: Region, *, end: bool) -> Column:
    """Numbers of the lines that a region accounts for: those selected, its
    heading and, where ``end``, the line that ends it, if their patterns describe
    the whole of them."""
    nums = lambda part: F.transform(part, lambda v: v["num"])
    if not region.selects:
        return nums(lines)

    def marks(b: Column) -> Column:
        parts = [nums(F.slice(lines, b["low"], F.greatest(b["high"] - b["low"] + 1, F.lit(0))))]
        for name, pattern, counts in (("heading", region.after, True), ("end", region.until, end)):
            if pattern and counts:
                at = F.get(lines, b[name] - 1)
                parts.append(F.when(covered_by(at["text"], pattern), F.array(at["num"])).otherwise(F.array().cast("array<int>")))
        return F.concat(*parts)

    return let(bounds(lines, region), marks)


def unread_refusal(lines: Column, read: Column) -> Column:
    """Why a capture is refused some of whose lines are not among the numbers read."""

    def told(rest: Column) -> Column:
        shown = F.array_join(F.transform(F.slice(rest, 1, MOST_TOLD), lambda v: F.concat(F.lit("line "), v["num"].cast("string"), F.lit(' "'), v["text"], F.lit('"'))), ", ")
        more = F.when(F.size(rest) > MOST_TOLD, F.concat(F.lit(" and "), (F.size(rest) - MOST_TOLD).cast("string"), F.lit(" more"))).otherwise("")
        return F.when(F.size(rest) > 0, F.concat(F.lit("lines that no part reads: "), shown, more))

    def left(nums: Column) -> Column:
        gone = F.array_except(F.transform(lines, lambda v: v["num"]), nums)
        return F.when(F.size(gone) == 0, F.filter(lines, lambda v: F.lit(False))).otherwise(F.filter(lines, lambda v: F.array_contains(gone, v["num"])))

    # most often all are read, in their order
    return let(read, lambda nums: F.when(nums != F.transform(lines, lambda v: v["num"]), let(left(nums), told)))


def regioned(captures: DataFrame, region: Region, *, others: bool = False, white: str = WHITE, verbatim: bool = False) -> DataFrame:
    """``captures`` with lines (those to be read), account and refusal (null if none).

    account: physical lines, folded, blank, ignored and selected ones, and for
    each pattern of ``ignore`` the lines that it is the first to match. What the
    region leaves out otherwise is a refusal, unless ``others`` read it. Blank lines
    are of the characters of ``white``; ``verbatim`` ones keep a carriage return and
    a BOM.
    """
    bytes_ = F.octet_length("text")
    df = captures.withColumn("raw", split_records(F.col("text"), region.separator))
    df = df.withColumn("raw_bytes", F.aggregate("raw", F.lit(0), lambda a, v: F.greatest(a, F.octet_length(v["text"]))))
    df = df.withColumn("raw", prepared(F.col("raw"), region, verbatim=verbatim))
    df = df.withColumn("joined", without_edge_blanks(F.col("raw"), region.skip_blank, white))
    why = [
        F.when(F.col("text").isNull(), F.lit("no text")),
        F.when(bytes_ > MOST_BYTES, F.lit("a capture of over 64 MiB")),
        F.when(~F.is_valid_utf8("text"), F.lit("not UTF-8")),
        F.when(F.col("raw_bytes") > MOST_RECORD_BYTES, F.lit("a record of over 1 MiB")),
    ]
    if region.separator == "\n":
        why.append(F.when(F.contains("text", F.lit("\x00")), F.lit("NUL in a text of lines")))
    if region.fold:
        why.append(fold_refusal(F.col("joined"), region.fold, white))
    df = df.withColumn("whole", folded(F.col("joined"), region.fold) if region.fold else F.col("joined"))
    stay = F.filter("whole", lambda v: ~is_blank(v["text"], white)) if region.skip_blank else F.col("whole")
    df = df.withColumn("full", stay)
    if region.ignore:  # the first pattern to match a line takes it
        taken = F.transform("full", lambda v: F.coalesce(*[F.when(translate(p).matches(v["text"]), k) for k, p in enumerate(region.ignore)], F.lit(-1)))
        df = df.withColumn("taken", taken).withColumn("kept", let(F.col("taken"), lambda t: F.filter("full", lambda v, k: F.get(t, k) < 0)))
        by_pattern = let(F.col("taken"), lambda t: F.transform(F.sequence(F.lit(0), F.lit(len(region.ignore) - 1)), lambda k: F.size(F.filter(t, lambda x: x == k))))
    else:
        df = df.withColumn("kept", F.col("full"))
        by_pattern = F.array().cast("array<int>")
    if region.selects:
        df = df.withColumn("lines", selected(F.col("kept"), region))
        if not others:
            why.append(unread_refusal(F.col("kept"), read_by(F.col("kept"), region, end=True)))
    else:
        df = df.withColumn("lines", F.col("kept"))
    why.append(F.when(F.size("lines") > MOST_VALUES, F.lit("over 4,194,304 values")))
    account = F.struct(
        F.size("raw").alias("lines"), (F.size("joined") - F.size("whole")).alias("folded"), (F.size("raw") - F.size("joined") + F.size("whole") - F.size("full")).alias("blank"),
        (F.size("full") - F.size("kept")).alias("ignored"), F.size("lines").alias("selected"), by_pattern.alias("ignored_by"),
    )
    return df.withColumn("account", account).withColumn("refusal", held(F.coalesce(*why))).drop("raw", "raw_bytes", "joined", "whole", "full", "taken", "kept")


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each line: capture_id, the kept columns, num and line. Where
    ``df`` has a refusal, so do the rows, as trouble; a capture that is refused
    has one row, of number 0."""
    if "refusal" not in df.columns:
        return df.select("capture_id", *keep, F.inline("lines").alias("num", "line"))
    one = F.array(F.struct(F.lit(0).alias("num"), F.lit("").alias("text")))
    lines = F.when(F.col("refusal").isNotNull(), one).otherwise(F.col("lines"))
    return df.select("capture_id", *keep, F.col("refusal").alias("trouble"), F.inline(lines).alias("num", "line"))
