"""Regular expressions of the linear-time dialect, rewritten for the JVM.

Definitions use the dialect without backreferences and lookaround that reads
``(?P<name>...)``. The JVM's engine differs in a few classes and anchors, which
``translate`` writes out, so that what matches is the same in either.

``match_array`` evaluates each pattern once a text and gives all groups of the
first match at once, as an array that is to be held in a column.

No line runs over the matcher's stack: repeated groups are possessive where that
changes no match (``loops``), and other patterns with them, the ``deep`` ones, are
matched by Arrow's kernels, which are linear in time. Only where such a pattern is
a condition inside an array of lines, which no kernel reaches, a line that is
longer than the stack allows ends the query with an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.workers import reach_workers
from .loops import POSIX, survey

#: White space of \s in the definitions' dialect.
SPACES = r"\t\n\f\r "
MOST_PATTERN = 2048
#: Edges of words, which have ASCII letters, digits and the underscore.
WORD = "[0-9A-Za-z_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
INSIDE = rf"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
#: The JVM's names of the dialect's classes.
JAVA_CLASSES = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}
#: Noncharacters that no text has: between the parts of a match, and before a text.
WHOLE = "shapewright_whole"
CUT, AHEAD = "﷐", "﷑"


class PatternError(ValueError):
    """A pattern that definitions may not use."""


@dataclass(frozen=True)
class Pattern:
    """A pattern for the JVM and the numbers of its named groups.

    ``parts`` is the pattern in pieces, with None and "" for where it says that
    the text begins and that a line of it does; ``optional`` names the groups
    that may take no part in a match. A ``deep`` pattern is matched in the JVM
    up to ``most`` characters; ``linear`` is the pattern for Arrow's kernels.
    """

    source: str
    parts: tuple[str | None, ...]
    groups: dict[str, int]
    count: int
    optional: frozenset[str]
    deep: bool = False
    most: int = 0
    linear: str = ""

    def written(self, text_begins: str = r"\A", line_begins: str = "^") -> str:
        return "".join(text_begins if p is None else p or line_begins for p in self.parts)

    @property
    def java(self) -> str:
        return "(?d)" + self.written()

    def within(self, text: Column, found: Column) -> Column:
        """``found``, which the JVM tells of ``text``, where its stack allows that; an error elsewhere."""
        if not self.deep:
            return found
        why = F.raise_error(F.lit(f"a text of over {self.most} characters under the pattern {self.source[:80]}"))
        return F.when(F.length(text) > self.most, why).otherwise(found)

    def matches(self, text: Column) -> Column:
        return self.within(text, text.rlike(self.java)).cast("boolean") if self.deep else text.rlike(self.java)


@dataclass(frozen=True)
class Found:
    """What ``first_match`` gives, read off the array that it made."""

    held: Column
    patterns: tuple[Pattern, ...]

    @property
    def which(self) -> Column:
        """The number of the pattern that matches; null if none does."""
        return F.get(self.held, F.lit(1)).cast("int")

    @property
    def covers(self) -> Column:
        """Whether the match leaves nothing but white space."""
        from .text import is_blank

        return is_blank(F.get(self.held, F.lit(2))) & is_blank(F.get(self.held, F.lit(3)))

    def group(self, k: int, name: str) -> Column:
        """A named group of pattern k, if that is the one: null if it took no part."""
        pattern = self.patterns[k]
        names = list(pattern.groups)
        value = F.get(self.held, F.lit(4 + names.index(name)))
        if name not in pattern.optional:
            return value
        flag = F.get(self.held, F.lit(4 + len(names) + [n for n in names if n in pattern.optional].index(name)))
        return F.when((value != "") | (flag != ""), value)


def match_array(text: Column, patterns: Sequence[Pattern]) -> Column:
    """The first match of the first pattern that matches: its number, what
    stands before and after it, its named groups, and for each group that may
    take no part a mark if it is empty and did. Shorter if nothing matches, null
    for a null text and one that holds the noncharacters used here.

    Each pattern is a replacement of the whole text by these parts, done to the
    text or to what the patterns before have left as it was. A group that took
    part is told by referring back to it: with nothing in it, it stands where
    one of the marks put before the text does.
    """
    ahead = max((len(p.optional) for p in patterns), default=0)
    at = F.concat(F.lit(AHEAD * ahead), text) if ahead else text
    for k, p in enumerate(patterns):
        names = list(p.groups)
        own = [n for n in names if n in p.optional]
        if ahead:
            body = p.written(rf"(?<={AHEAD})", rf"(?<=[{AHEAD}\n])")
            refer = "".join(rf"(?:\{p.groups[n] + 1}({AHEAD})|{AHEAD})" for n in own)
            whole = rf"(?d)\A(?={AHEAD}{{{ahead}}}((?s:.*?))(?:{body})((?s:.*))\z){refer}(?s:.*)\z"
        else:
            whole = rf"(?d)\A(?!{CUT})((?s:.*?))(?:{p.written()})((?s:.*))\z"
        after = p.count + 2
        shown = ["$1", f"${after}", *[f"${p.groups[n] + 1}" for n in names], *[f"${after + 1 + j}" for j in range(len(own))]]
        at = p.within(text, F.regexp_replace(at, whole, CUT + CUT.join([str(k), *shown])))
    return F.when(~text.contains(CUT) & ~text.contains(AHEAD), F.split(at, CUT, -1))


def _linear(texts: pa.Array, patterns: Sequence[tuple[str, tuple[str, ...], tuple[str, ...]]]) -> pa.Array:
    """What ``match_array`` tells of each text; patterns are (source, groups, those that may take no part)."""
    out: list[list[str] | None] = [None if t is None or CUT in t or AHEAD in t else [t] for t in texts.to_pylist()]
    left = [k for k, t in enumerate(out) if t is not None]
    for number, (source, groups, optional) in enumerate(patterns):
        if not left:
            break
        spans = pc.extract_regex_span(texts.take(pa.array(left)), f"(?P<{WHOLE}>{source})").to_pylist()
        for k, span in zip(left, spans, strict=True):
            if span is not None:
                raw = out[k][0].encode()
                cut = {n: None if at is None else raw[at[0] : at[0] + at[1]].decode() for n, at in span.items()}
                begins, length = span[WHOLE]
                marks = [AHEAD if cut[n] == "" else "" for n in optional]
                out[k] = ["", str(number), raw[:begins].decode(), raw[begins + length :].decode(), *[cut[n] or "" for n in groups], *marks]
        left = [k for k, span in zip(left, spans, strict=True) if span is None]
    return pa.array(out, pa.list_(pa.string()))


def linear_matches(texts: Column, patterns: Sequence[Pattern]) -> Column:
    """``match_array`` of each of an array of texts, by Arrow's linear-time kernels.
    It can't stand inside a lambda."""
    told = [(p.linear, tuple(p.groups), tuple(n for n in p.groups if n in p.optional)) for p in patterns]
    reach_workers(SparkSession.active())

    @F.arrow_udf("array<array<string>>")
    def found(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(ends, _linear(lists.flatten(), told), mask=lists.is_null() if lists.null_count else None)

    return found(texts)


class _Scan:
    """Which groups may take no part: those under a quantifier from zero, or beside a bar."""

    def __init__(self):
        self.open: list[dict] = [{"names": [], "bar": False, "own": None}]
        self.optional: set[str] = set()

    def begin(self, name: str | None) -> None:
        self.open.append({"names": [], "bar": False, "own": name})

    def end(self, rest: str) -> None:
        level = self.open.pop()
        if level["bar"]:
            self.optional.update(level["names"])
        names = level["names"] + ([level["own"]] if level["own"] else [])
        if rest[:1] in ("?", "*") or rest.startswith("{0"):
            self.optional.update(names)
        self.open[-1]["names"] += names

    def done(self) -> frozenset[str]:
        if self.open[0]["bar"]:
            self.optional.update(self.open[0]["names"])
        return frozenset(self.optional)


@cache
def translate(source: str) -> Pattern:
    """Rewrites one pattern."""
    if len(source) > MOST_PATTERN:
        raise PatternError(f"a pattern of over {MOST_PATTERN} characters")
    out: list[str | None] = []
    groups: dict[str, int] = {}
    scan = _Scan()
    loops = survey(source)
    linear, done = "", 0  # names are all that its groups may be there
    number, at, in_class, depth = 0, 0, False, 0
    multiline = source.startswith("(?") and "m" in source[2 : max(source.find(")"), 2)].split(":")[0].split("-")[0]
    while at < len(source):
        if at in loops.possessive:
            out.append("+")
            if source.startswith("?", at):  # where no two ways begin alike, the least rounds are the most
                at += 1
                continue
        c = source[at]
        if c == "\\" and at + 1 < len(source):
            following = source[at + 1]
            if following in "sS":
                body = SPACES if following == "s" else None
                if in_class and body is None:
                    out.append(rf"\S{chr(92)}x0B")
                else:
                    out.append(SPACES if in_class else f"[{'' if body else '^'}{SPACES}]")
            elif following == "z":
                out.append(r"\z")
            elif following == "A" and not in_class:
                out.append(None)
            elif following in "bB" and not in_class:
                out.append(EDGE if following == "b" else INSIDE)
            elif following.isdigit() and following != "0":
                raise PatternError("a pattern may not refer back to a group")
            else:
                out.append(c + following)
            at += 2
            continue
        if in_class:
            if c == "[" and source.startswith("[:", at):
                end = source.find(":]", at) + 2
                name = source[at + 2 : end - 2]
                denied, name = name.startswith("^"), name.removeprefix("^")
                if name not in POSIX or end < 2:
                    raise PatternError(f"no class is named {name[:20]}")
                out.append(("\\W" if denied else "\\w") if name == "word" else r"\%s{%s}" % ("P" if denied else "p", JAVA_CLASSES[name]))
                at = end
                continue
            out.append("\\" + c if c in "[&" else c)
            if c == "]":
                in_class = False
            at += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            at += 1
            if source.startswith("^", at):
                out.append("^")
                at += 1
            if source.startswith("]", at):
                out.append(r"\]")
                at += 1
            continue
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise PatternError("a parenthesis that none opens")
        if c == "(":
            rest = source[at:]
            if rest.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>")):
                raise PatternError("a pattern may not look around")
            named = next((p for p in ("(?P<", "(?<") if rest.startswith(p)), None)
            if named:
                end = source.index(">", at)
                number += 1
                name = source[at + len(named) : end]
                if name in groups:
                    raise PatternError(f"the group {name} is named twice")
                groups[name] = number
                scan.begin(name)
                out.append("(")
                linear, done = linear + source[done:at] + "(?P<", at + len(named)
                at = end + 1
                continue
            scan.begin(None)
            if not rest.startswith("(?"):
                number += 1
                linear, done = linear + source[done:at] + "(?:", at + 1
            else:  # flags, and what of a group they are for
                end = next((k for k, x in enumerate(rest[2:], at + 2) if x in ":)"), len(source))
                flags = source[at + 2 : end]
                if set(flags) - set("ims-"):
                    raise PatternError(f"no flags are {flags[:20]}")
                on, off = flags.split("-", 1) if "-" in flags else (flags, "")
                out.append("(?" + on + "u" * ("i" in on) + ("-" + off if off else "") + source[end : end + 1])  # folds as Unicode does
                if source[end : end + 1] == ")":
                    scan.end(source[end + 1 :])
                    depth -= 1
                at = end + 1
                continue
        elif c == ")":
            scan.end(source[at + 1 :])
        elif c == "|":
            scan.open[-1]["bar"] = True
        if c == "$" and not multiline:
            out.append(r"\z")
        elif c == "^":
            out.append("" if multiline else None)
        else:
            out.append(c)
        at += 1
    if depth or in_class:
        raise PatternError("a parenthesis or bracket that isn't closed")
    if len(source) in loops.possessive and (not out or out[-1] != "+"):
        out.append("+")
    return Pattern(source, tuple(out), groups, number, scan.done(), loops.deep, loops.most, linear + source[done:])


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns matches."""
    found = F.lit(False)
    for p in patterns:
        found = found | translate(p).matches(text)
    return found


def covered_by(text: Column, pattern: str) -> Column:
    """Whether the first match of a pattern leaves nothing of a text but white space."""
    from .text import let

    found = translate(pattern)
    return F.coalesce(let(match_array(text, [found]), lambda m: Found(m, (found,)).covers & Found(m, (found,)).which.isNotNull()), F.lit(False))
