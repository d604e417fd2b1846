"""Field rules: from the text of a cell to a typed value.

A rule is compiled to two columns, the value and the reason why the cell was
refused (null if it wasn't). Cells are null if absent; an empty cell is ``''``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import Found, match_array, translate
from .text import is_blank, let, literal, trimmed, unescaped

#: Spellings of truth.
TRUE = ("true", "yes", "on", "1", "y")
FALSE = ("false", "no", "off", "0", "n")
#: Seconds of each unit of a duration, in nanoseconds.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86_400 * 10**9, "w": 604_800 * 10**9}
KINDS = ("string", "int", "wide_int", "float", "bool", "duration", "time", "array", "object")


@dataclass(frozen=True)
class Field:
    """A rule for one key."""

    type: str = "string"
    required: bool = False
    null_if: tuple[str, ...] = ()
    trim_prefix: str = ""
    trim_suffix: str = ""
    group_separator: str = ""
    omit: bool = False
    regex: str = ""
    split: str = ""
    split_regex: str = ""
    items: Field | None = None
    fields: dict[str, Field] = field(default_factory=dict)
    true: tuple[str, ...] = TRUE
    false: tuple[str, ...] = FALSE
    layout: str = ""
    #: What a time is taken to be that doesn't tell its year or its zone's offset.
    year: int | None = None
    recent: datetime | None = None
    zones: dict[str, str] = field(default_factory=dict)
    #: Escapes of a string and what they stand for; ``unescape_when`` names the
    #: key of the same line that must hold text for them to be undone.
    unescape: dict[str, str] = field(default_factory=dict)
    octal: bool = False
    quote: str = ""
    unescape_when: str = ""


def ungrouped(text: Column, separator: str) -> Column:
    """Digits without group separators; null unless grouped in threes, or not at all."""
    sep = literal(separator)
    right = text.rlike(rf"\A[+-]?(?:[0-9]{{1,3}}(?:{sep}[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?\z")
    return F.when(right, F.replace(text, F.lit(separator), F.lit("")))


def to_int(text: Column) -> Column:
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def to_wide_int(text: Column) -> Column:
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("decimal(38,0)"))


def to_float(text: Column) -> Column:
    """Decimal spelling only; what overflows, or isn't zero and underflows, is refused."""
    # without an exponent, a short number does neither
    short = text.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z") & (F.length(text) < 300)

    def checked(t: Column) -> Column:
        number = F.when(t.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), t.try_cast("double"))
        return let(number, lambda n: F.when((F.abs(n) != float("inf")) & ((n != 0) | t.rlike(r"\A[+-]?[0.]+(?:[eE].*)?\z")), n))

    return F.when(short, text.try_cast("double")).otherwise(checked(text))


def to_bool(text: Column, true: tuple[str, ...] = TRUE, false: tuple[str, ...] = FALSE) -> Column:
    low = F.lower(text)
    return F.when(low.isin([t.lower() for t in true]), True).when(low.isin([f.lower() for f in false]), False)


_CLOCKS = [
    r"^(?:(?P<d>[0-9]+)-)?(?:(?P<h>[0-9]+):)?(?P<m>[0-9]+):(?P<s>[0-9]+(?:\.[0-9]{1,9})?)s?$",
    r"^(?:(?P<d>[0-9]+)-)?(?P<h>[0-9]+):(?P<m>[0-9]{1,2})m$",
    r"^(?P<d>[0-9]+) *days?, *(?P<h>[0-9]+):(?P<m>[0-9]{1,2})$",
]
#: Spellings of units, from the largest.
_SPELLED = {"w": "weeks?|w", "d": "days?|d", "h": "hours?|hrs?|h", "m": "minutes?|mins?|m", "s": "seconds?|secs?|s", "ms": "ms", "us": "us|µs|μs", "ns": "ns"}
_UNITS = "^" + "".join(rf"(?:(?P<{k}>[0-9]+(?:\.[0-9]{{1,9}})?) *(?:{v})(?: *, *| +|$)?)?" for k, v in _SPELLED.items()) + "$"


def to_duration(text: Column, layout: str = "") -> Column:
    """Seconds, as decimal(38,9): ``[days-][[h:]mm:]ss[.fff]``, ``13:42m`` for
    hours and minutes, ``13 days, 4:30``, or numbers with units from the largest
    to the smallest. Parts of a clock after the first are below 60, and nothing
    is over 2^53. With ``layout`` h:m, two parts are hours and minutes."""
    clocks, units = tuple(map(translate, _CLOCKS)), translate(_UNITS)

    def clock(m: Column) -> Column:
        found = Found(m, clocks)
        first = found.which == 0

        def whole(n: str) -> Column:
            at = F.when(first, found.group(0, n))
            for k in (1, 2):
                at = at.when(found.which == k, found.group(k, n)) if n in clocks[k].groups else at
            return at.try_cast("bigint")

        parts = F.struct(whole("d").alias("d"), whole("h").alias("h"), whole("m").alias("m"), F.when(first, found.group(0, "s")).try_cast("decimal(20,9)").alias("s"), first.alias("first"))

        def seconds(p: Column) -> Column:
            zero = F.lit(0).cast("long")
            two = p["first"] & p["h"].isNull()  # of two parts the first may be any number
            fits = (p["s"].isNull() | (p["s"] < 60)) & (two | (p["m"] < 60)) & ~(two & p["d"].isNotNull())
            scale = F.when(two, 60).otherwise(1) if layout == "h:m" else F.lit(1)
            minutes = (F.coalesce(p["d"], zero) * 1440 + F.coalesce(p["h"], zero) * 60 + p["m"]) * 60 * scale
            return F.when(fits, minutes.cast("decimal(20,0)") + F.coalesce(p["s"], F.lit(0).cast("decimal(20,9)")) * scale).cast("decimal(38,9)")

        return F.when(found.which.isNotNull(), let(parts, seconds))

    def run(m: Column) -> Column:
        found = Found(m, (units,))
        total, some = F.lit(0).cast("decimal(38,9)"), F.lit(False)
        for n in units.groups:
            part = found.group(0, n)
            total = (total + F.when(part.isNotNull(), (part.try_cast("decimal(20,9)") * F.lit(Decimal(UNITS[n]).scaleb(-9))).cast("decimal(38,9)")).otherwise(F.lit(0).cast("decimal(38,9)"))).cast("decimal(38,9)")
            some = some | part.isNotNull()
        return F.when(found.which.isNotNull() & some, total)

    def value(t: Column) -> Column:
        plain = t.rlike(r"\A[0-9]+(?:\.[0-9]{1,9})?\z")
        return F.when(plain, t.try_cast("decimal(38,9)")).when(t.contains(":"), let(match_array(t, clocks), clock)).otherwise(let(match_array(t, [units]), run))

    return let(let(text, value), lambda v: F.when(v <= 1 << 53, v))


def _printed(micros: Column, offset: Column) -> Column:
    """RFC 3339 of an instant on the clock that is ``offset`` seconds ahead; the
    session's zone plays no part."""
    away = ((micros + offset.cast("long") * 1_000_000) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    clock = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), away)
    minutes = F.abs(offset / 60).cast("int")
    shown = F.concat(F.when(offset < 0, "-").otherwise("+"), F.lpad((minutes / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return F.concat(F.translate(clock.cast("string"), " ", "T"), F.when(offset == 0, "Z").otherwise(shown))


def offset_seconds(text: str) -> int:
    """Seconds ahead of UTC of ``+0900``."""
    if not re.fullmatch(r"[+-](?:[01][0-9]|2[0-3])[0-5][0-9]", text):
        raise ValueError(f"not an offset like +0900: {text}")
    return (1 if text[0] == "+" else -1) * (int(text[1:3]) * 3600 + int(text[3:]) * 60)


def to_time(text: Column, layout: str, *, year: int | None = None, recent: datetime | None = None, zones: Mapping[str, str] | None = None) -> Column:
    """RFC 3339 on the printed form's own clock; ``layout`` is a Spark pattern.

    Without a zone in the layout the clock is UTC's. Where the layout has no
    year, ``year`` is it, or the latest of eight years that puts the time no more than
    a day after ``recent``; a ``z`` in the layout is an abbreviation, which
    ``zones`` maps to offsets like +0900 (UTC, GMT and Z are known). What would
    need an assumption that isn't made stays as printed. Microseconds are kept.
    """
    if "y" not in layout and year is None and recent is None:
        dated = F.try_to_timestamp(F.concat(F.lit("2000 "), text), F.lit(f"yyyy {re.sub(' ?z+', '', layout)}")) if "z" not in layout else F.lit(0)
        return F.when(dated.isNotNull(), text)
    known = {"UTC": 0, "GMT": 0, "Z": 0, **{k: offset_seconds(v) for k, v in (zones or {}).items()}}
    abbreviation = r"\b([A-Z]{1,5})\b(?=[^A-Z]*\z)"
    stated = re.search("[XxZ]+", re.sub("'[^']*'", "", layout))
    unknown = F.lit(False)
    if "z" in layout:
        name = F.regexp_extract(text, abbreviation, 1)
        offset = F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), name)
        unknown = (name != "") & offset.isNull()
        text_, pattern = F.regexp_replace(text, abbreviation, "+0000"), re.sub("z+", "xx", layout)
    elif stated:
        printed = r"([+-])([0-9]{2}):?([0-9]{2})?[^0-9+-]*\z"
        size = F.coalesce(F.regexp_extract(text, printed, 2).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(F.regexp_extract(text, printed, 3).try_cast("int"), F.lit(0)) * 60
        offset = F.when(F.regexp_extract(text, printed, 1) == "-", -size).otherwise(size)
        text_, pattern = text, layout
    else:
        offset, text_, pattern = F.lit(0), F.concat(text, F.lit(" +0000")), f"{layout} xx"

    def instant(y: int | None) -> Column:
        """Microseconds of the time in a year; an abbreviation's clock is brought to UTC."""
        stamp = F.try_to_timestamp(text_, F.lit(pattern)) if y is None else F.try_to_timestamp(F.concat(F.lit(f"{y:04d} "), text_), F.lit(f"yyyy {pattern}"))
        micros = F.unix_micros(stamp)
        return micros - F.coalesce(offset, F.lit(0)).cast("long") * 1_000_000 if "z" in layout else micros

    if "y" in layout:
        micros = instant(None)
    elif year is not None:
        micros = instant(year)
    else:
        limit = recent + timedelta(days=1)
        most = int(limit.timestamp()) * 1_000_000 + limit.microsecond
        micros = F.coalesce(*[F.when(instant(y) <= most, instant(y)) for y in range(limit.year, limit.year - 8, -1)])
    return F.when(unknown & micros.isNotNull(), text).otherwise(_printed(micros, offset))


@dataclass(frozen=True)
class Text:
    """A cell's text after the rules for texts: whether it was there at all, and
    whether a rule doesn't fit it. ``groups`` is a match whose groups an object's
    keys are (null otherwise)."""

    text: Column
    missing: Column
    unfit: Column
    groups: Column | None = None


def as_text(cell: Column, rule: Field, line: Mapping[str, Column] | None = None) -> Text:
    """What of a cell is typed. ``line`` has the other cells of its line."""
    text, groups = cell, None
    if rule.trim_prefix or rule.trim_suffix:
        text = trimmed(text)
        if rule.trim_prefix:
            text = trimmed(F.when(F.startswith(text, F.lit(rule.trim_prefix)), F.substring(text, F.lit(len(rule.trim_prefix) + 1), F.length(text))).otherwise(text))
        if rule.trim_suffix:
            text = trimmed(F.when(F.endswith(text, F.lit(rule.trim_suffix)), F.substring(text, F.lit(1), F.length(text) - len(rule.trim_suffix))).otherwise(text))
    unfit = F.lit(False)
    if rule.type == "string" and rule.regex:
        pattern = translate(rule.regex)
        (name,) = pattern.groups
        got = let(match_array(text, [pattern]), lambda m: F.struct(Found(m, (pattern,)).group(0, name).alias("text"), (Found(m, (pattern,)).which.isNotNull() & Found(m, (pattern,)).covers).alias("fits")))
        unfit = text.isNotNull() & ~F.coalesce(got["fits"], F.lit(False))
        text = got["text"]
    missing = text.isNull()
    if rule.type == "string" and rule.unescape:
        whole = unescaped(text, rule.unescape, octal=rule.octal, quote=rule.quote)
        if rule.unescape_when:
            escaped = F.coalesce((line or {})[rule.unescape_when] != "", F.lit(False))
            whole = F.when(escaped, whole).otherwise(text)
        unfit = unfit | (text.isNotNull() & whole.isNull())
        text = whole
    if rule.null_if:
        text = F.when(~F.coalesce(trimmed(text).isin(list(rule.null_if)), F.lit(False)), text)
    if rule.type != "string":
        text = trimmed(text)
    if rule.group_separator:
        plain = ungrouped(text, rule.group_separator)
        unfit = unfit | (text.isNotNull() & plain.isNull())
        text = plain
    if rule.type == "object":
        pattern = translate(rule.regex)
        groups = match_array(text, [pattern])
    return Text(text, missing, unfit, groups)


def as_value(got: Text, rule: Field, key: str) -> tuple[Column, Column | None]:
    """The typed value of a text, and for arrays and objects why parts of it are refused."""
    text = got.text
    if rule.type == "string":
        return text, None
    if rule.type == "array":
        item = rule.items or Field()

        def pieces(t: Column) -> Column:
            cut = F.transform(F.split(t, rule.split_regex or literal(rule.split)), lambda x: F.struct(*[c.alias(n) for c, n in zip(compiled(trimmed(x), item, key), ("value", "why"), strict=True)]))
            return F.when(t != "", cut).otherwise(F.when(t.isNotNull(), F.filter(cut, lambda _: F.lit(False))))

        all_ = let(text, pieces)
        if item.omit:
            all_ = F.filter(all_, lambda p: p["value"].isNotNull() | p["why"].isNotNull())
        inner = F.array_join(F.transform(all_, lambda p: p["why"]), "; ")
        return F.transform(all_, lambda p: p["value"]), F.when(inner != "", inner)
    if rule.type == "object":
        pattern = translate(rule.regex)
        found = Found(got.groups, (pattern,))
        parts = {name: compiled(found.group(0, name), rule.fields.get(name, Field()), f"{key}.{name}") for name in pattern.groups}
        value = F.when(text.isNotNull(), F.struct(*[v.alias(n) for n, (v, _) in parts.items()]))
        inner = F.when(~F.coalesce(found.covers & found.which.isNotNull(), F.lit(False)), F.concat(F.lit(f"{key}: not object: "), text)).otherwise(F.concat_ws("; ", *[w for _, w in parts.values()]))
        return value, F.when(text.isNotNull() & (inner != ""), inner)
    if rule.type == "bool":
        return to_bool(text, rule.true, rule.false), None
    if rule.type == "duration":
        return to_duration(text, rule.layout), None
    if rule.type == "time":
        return to_time(text, rule.layout, year=rule.year, recent=rule.recent, zones=rule.zones), None
    return {"int": to_int, "wide_int": to_wide_int, "float": to_float}[rule.type](text), None


def why_not(cell: Column, got: Text, value: Column, inner: Column | None, rule: Field, key: str) -> Column:
    """Why a cell is refused; null if it isn't."""
    unfit = got.unfit
    if rule.type not in ("string", "array", "object"):
        unfit = unfit | (got.text.isNotNull() & value.isNull())
    why = F.when(unfit, F.concat(F.lit(f"{key}: not {rule.type}: "), F.coalesce(cell, F.lit(""))))
    why = why.otherwise(inner) if inner is not None else why
    if rule.required:
        why = F.when(got.missing | (got.text.isNotNull() & is_blank(got.text)), F.lit(f"{key}: required")).otherwise(why)
    return why


def compiled(cell: Column, rule: Field, key: str, line: Mapping[str, Column] | None = None) -> tuple[Column, Column]:
    """The value of a cell under a rule, and why it is refused. ``line`` has the
    other cells of its line. Where many cells are typed, ``parse`` holds each step
    in columns instead, so that none is computed twice."""
    got = as_text(cell, rule, line)
    value, inner = as_value(got, rule, key)
    return value, why_not(cell, got, value, inner, rule, key)
