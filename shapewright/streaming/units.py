"""What of a stream's lines is ready to be read, told as soon as it is.

A capture's lines go through its shape's steps one after another: folding, blank
lines, ignored ones, selection, and for a composite each part's region. What the
steps hold (counters, a line that may be folded into, blank lines that may be
the last, the open record, node or region of each part) is the state of the
capture, all of it under one account of bytes. What comes out are units: the
lines that one value is read from, by the plan that reads whole texts.

    lines read one by one     a unit each
    tables below a heading    the heading and a line
    CSV                       the heading and a record, once no quote is open
    trees, records            a node of the top level, a record, once the next begins
    all else                  the lines of a region, once it ends

Patterns are matched by Arrow's linear-time kernels, all of a batch's lines at a
time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc

from ..functions.patterns import WHOLE, translate
from ..functions.text import WHITE
from ..operators.csv_text import quote_open
from ..operators.lines import MOST_BYTES, MOST_RECORD_BYTES, Region
from ..plans.choice import Head, choices
from ..plans.shape import Shape
from .buckets import Capture, Line

#: A unit: the part's name and its lines.
Unit = tuple[str, list[Line]]


class Refused(Exception):
    """Ends a capture."""


class Texts:
    """Which texts of some captures' lines the patterns match, each found for all at
    once. Arrays are made once a pattern is asked for: many captures ask for none."""

    def __init__(self, captures: Sequence[Sequence[Line]]):
        self.captures = captures
        self.found: dict[tuple[str, bool], list[bool]] = {}

    @cached_property
    def at(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(dict.fromkeys(t for lines in self.captures for _, t in lines))}

    @cached_property
    def texts(self) -> pa.Array:
        return pa.array(list(self.at), pa.string())

    def __call__(self, pattern: str, whole: bool) -> list[bool]:
        if (pattern, whole) not in self.found:
            linear = translate(pattern).linear
            if whole:
                spans = pc.extract_regex_span(self.texts, f"(?P<{WHOLE}>{linear})").to_pylist()
                self.found[pattern, True] = [s is not None and _covers(t, *s[WHOLE]) for t, s in zip(self.at, spans, strict=True)]
            else:
                self.found[pattern, False] = pc.match_substring_regex(self.texts, linear).to_pylist()
        return self.found[pattern, whole]


def _covers(text: str, begins: int, length: int) -> bool:
    raw = text.encode()
    return not (raw[:begins] + raw[begins + length :]).decode().strip(WHITE)


class Hits:
    """Which of some lines the patterns match; ``many`` are texts of other captures
    too, looked at together where these lines are among them."""

    def __init__(self, lines: Sequence[Line], many: Texts | None = None):
        self.lines, self.many = lines, many

    @cached_property
    def of(self) -> Texts:
        shared = self.many is not None and all(t in self.many.at for _, t in self.lines)
        return self.many if shared else Texts([self.lines])

    def __call__(self, pattern: str, k: int, whole: bool = False) -> bool:
        return self.of(pattern, whole)[self.of.at[self.lines[k][1]]]


@dataclass
class Place:
    """How far a region has come."""

    inside: bool = False
    over: bool = False
    skipped: int = 0
    taken: int = 0

    def role(self, region: Region, hits: Hits, k: int) -> str:
        """What a line is to the region: its heading, in it, its end, or out."""
        if not self.inside and not self.over:
            self.inside = not region.after
            if region.after:
                self.inside = hits(region.after, k)
                return "heading" if self.inside else "out"
        if self.over:
            return "out"
        if region.until and hits(region.until, k):
            self.over = True
            return "end"
        if self.skipped < region.skip:
            self.skipped += 1
            return "out"
        if region.limit is not None and self.taken >= region.limit:
            return "out"
        self.taken += 1
        return "in"

    def full(self, region: Region) -> bool:
        """Whether no line will be in the region any more."""
        return self.over or (region.limit is not None and self.taken >= region.limit)


def kind_of(shape: Shape) -> str:
    """How the lines of a shape make units."""
    if shape.line_reader() is not None:
        return "line"
    return {"table": "headed", "aligned": "headed", "csv": "csv", "tree": "tree", "records": "records"}.get(shape.parse, "whole")


def kinds_of(shape: Shape) -> dict[str, str]:
    """How the lines of each part make units."""
    return {n: kind_of(p) for n, p in (shape.parts.items() if shape.parse == "composite" else [("", shape)])}


@dataclass
class Open:
    """What a part holds."""

    place: Place = field(default_factory=Place)
    head: list[Line] = field(default_factory=list)
    lines: list[Line] = field(default_factory=list)
    quoted: bool = False
    done: bool = False


def _size(text: str) -> int:
    """Bytes of a text."""
    return len(text) if text.isascii() else len(text.encode())


def _words(text: str) -> list[str]:
    return text.split()


class Reader:
    """One capture under a shape. ``state`` and ``Reader(shape, state)`` keep it between batches."""

    def __init__(self, shape: Shape, state: dict | None = None, most: int = MOST_BYTES, kinds: dict[str, str] | None = None, many: Texts | None = None):
        self.many = many
        self.shape, self.most, self.kinds = shape, most, kinds or kinds_of(shape)
        self.parts = dict(shape.parts) if shape.parse == "composite" else {"": shape}
        state = state or {}
        self.top = Place(**state.get("top", {}))
        self.open = {n: Open(**{**o, "place": Place(**o["place"]), "head": [tuple(x) for x in o["head"]], "lines": [tuple(x) for x in o["lines"]]}) for n, o in state.get("open", {}).items()} or {n: Open() for n in self.parts}
        self.blanks: list[int] = state.get("blanks", [])
        self.begun: bool = state.get("begun", False)
        self.folding: list[Line] = [tuple(x) for x in state.get("folding", [])]
        self.before_blank: bool = state.get("before_blank", True)

    def state(self) -> dict:
        return {"top": asdict(self.top), "open": {n: asdict(o) for n, o in self.open.items()}, "blanks": self.blanks, "begun": self.begun, "folding": self.folding, "before_blank": self.before_blank}

    def held(self) -> int:
        """Bytes that the capture holds, of all parts together."""
        kept = [self.folding, *[o.head for o in self.open.values()], *[o.lines for o in self.open.values()]]
        return sum(_size(t) + 1 for lines in kept for _, t in lines) + len(self.blanks)

    def feed(self, lines: Sequence[Line], last: bool) -> Iterator[Unit]:
        """Units that these lines complete; ``last`` if the capture ends with them."""
        held = self.held()
        for group in self._pieces(lines):
            for unit in self._through(group, False):
                yield unit
                held = None
            held = self.held() if held is None else held + sum(_size(t) + 1 for _, t in group)
            if held > self.most and (held := self.held()) > self.most:
                raise Refused(f"what waits to be read exceeds {self.most} bytes")
        if last:
            yield from self._through([], True)

    def _pieces(self, lines: Sequence[Line], size: int = 4096) -> Iterator[Sequence[Line]]:
        """Lines some at a time, so that the account is looked at between."""
        begun, bytes_ = 0, 0
        for k, (num, text) in enumerate(lines):
            own = _size(text)
            if own > MOST_RECORD_BYTES:
                raise Refused(f"a record of over 1 MiB at line {num}")
            if "\0" in text and self.shape.region.separator == "\n":
                raise Refused("NUL in a text of lines")
            bytes_ += own + 1
            if k - begun >= size or bytes_ > self.most // 8:
                yield lines[begun : k + 1]
                begun, bytes_ = k + 1, 0
        if begun < len(lines):
            yield lines[begun:]

    def _through(self, lines: Sequence[Line], last: bool) -> Iterator[Unit]:
        region = self.shape.region
        whole = self._folded(self._without_edges(lines), last)
        if region.skip_blank:
            whole = [x for x in whole if x[1].strip(WHITE)]
        hits = Hits(whole, self.many)
        for k, (num, text) in enumerate(whole):
            if region.ignore and any(hits(p, k) for p in region.ignore):
                continue
            yield from self._line(num, text, hits, k)
        if last:
            for name, part in self.parts.items():
                yield from self._close(name, part)

    def _without_edges(self, lines: Sequence[Line]) -> list[Line]:
        """Without empty lines at the capture's ends, where blank ones count."""
        if self.shape.region.skip_blank:
            return list(lines)
        out: list[Line] = []
        for num, text in lines:
            if text:
                out += [(n, "") for n in self.blanks] if self.begun else []
                self.blanks, self.begun = [], True
                out.append((num, text))
            else:
                self.blanks.append(num)
        return out

    def _folded(self, lines: list[Line], last: bool) -> list[Line]:
        """Lines with those that continue them; the last stays open."""
        fold = self.shape.region.fold
        if not fold:
            return lines
        out, hits = [], Hits(lines, self.many)
        join = lambda held: (held[0][0], held[0][1] if len(held) == 1 else " ".join(t.strip(WHITE) for _, t in held))
        for k, line in enumerate(lines):
            if hits(fold, k):
                if not self.folding or self.before_blank:
                    raise Refused(f"nothing to fold into at line {line[0]}")
                self.folding.append(line)
            else:
                out += [join(self.folding)] if self.folding else []
                self.folding = [line]
            self.before_blank = not line[1].strip(WHITE)
        if last and self.folding:
            out.append(join(self.folding))
            self.folding = []
        return out

    def _line(self, num: int, text: str, hits: Hits, k: int) -> Iterator[Unit]:
        region = self.shape.region
        if region.selects:
            role = self.top.role(region, hits, k)
            if role != "in":
                if not (role == "heading" and hits(region.after, k, True) or role == "end" and hits(region.until, k, True)):
                    raise Refused(f'lines that no part reads: line {num} "{text}"')
                if role == "end":
                    for name, part in self.parts.items():
                        yield from self._close(name, part)
                return
        if self.shape.parse != "composite":
            yield from self._into("", self.shape, num, text, hits, k)
            if region.selects and self.top.full(region):
                yield from self._close("", self.shape)
            return
        read = False
        for name, part in self.parts.items():
            own = self.open[name]
            if own.done and (own.place.inside or own.place.over):
                continue
            role = own.place.role(part.region, hits, k)
            if role == "heading":
                read |= hits(part.region.after, k, True)
            elif role == "in" and not (part.region.skip_blank and not text.strip(WHITE)) and not (part.region.ignore and any(hits(p, k) for p in part.region.ignore)):
                read = True
                yield from self._into(name, part, num, text, hits, k)
            if own.place.full(part.region):
                yield from self._close(name, part)
        if not read:
            raise Refused(f'lines that no part reads: line {num} "{text}"')

    def _into(self, name: str, part: Shape, num: int, text: str, hits: Hits, k: int) -> Iterator[Unit]:
        """A line that is in a part's region."""
        own, kind = self.open[name], self.kinds[name]
        if kind == "line":
            yield name, [(num, text)]
        elif kind == "headed":
            if own.head and (part.parse != "aligned" or _words(text) != _words(own.head[0][1])):
                yield name, [*own.head, (num, text)]
            else:
                own.head = [(num, text)]
                own.quoted = False
        elif kind == "csv":
            own.lines.append((num, text))
            own.quoted = quote_open(text, part.delimiter or ",", own.quoted)
            if not own.quoted:
                if not own.head and (part.header or not part.columns):
                    own.head = own.lines
                else:
                    yield name, [*own.head, *own.lines]
                own.lines = []
        elif kind in ("tree", "records"):
            units = [part.indent] if isinstance(part.indent, str) else part.indent
            begins = hits(part.start, k) if kind == "records" else not text.startswith(tuple(units)) and not text[:1] in (" ", "\t")
            if begins and own.lines:
                yield name, own.lines
                own.lines = []
            own.lines.append((num, text))
        else:
            own.lines.append((num, text))

    def _close(self, name: str, part: Shape) -> Iterator[Unit]:
        """What a part holds, where its region is over."""
        own, kind = self.open[name], self.kinds[name]
        if own.done:
            return
        own.done = True
        if kind in ("tree", "records", "csv") and own.lines or kind == "whole":
            yield name, own.lines if kind != "csv" else [*own.head, *own.lines]
        own.head, own.lines = [], []


#: Captures, their lines, and characters of what they hold, that are looked at together.
AT_ONCE, AT_ONCE_LINES, AT_ONCE_CHARACTERS = 4096, 1 << 16, 8 << 20


def _together(captures: Iterable[Capture]) -> Iterator[tuple[list[Capture], Texts | None]]:
    """Captures some at a time, with the texts of all their new lines."""
    group: list[Capture] = []
    count = size = 0

    def made() -> tuple[list[Capture], Texts | None]:
        return group, Texts([lines for _, lines, _ in group]) if len(group) > 1 else None

    for capture in captures:
        lines, own = len(capture[1]), _held(capture[0]) + sum(len(t) for _, t in capture[1])
        if group and (len(group) >= AT_ONCE or count + lines > AT_ONCE_LINES or size + own > AT_ONCE_CHARACTERS):
            yield made()
            group, count, size = [], 0, 0
        group.append(capture)
        count, size = count + lines, size + own
    if group:
        yield made()


def _held(kept: dict | str | None) -> int:
    """Characters of the lines that a capture keeps, before its definition is known and after."""
    if kept is None or kept == REFUSED:
        return 0
    reader = kept.get("reader", {})
    own = [kept.get("held", []), reader.get("folding", []), *[o[k] for o in reader.get("open", {}).values() for k in ("head", "lines")]]
    return sum(len(t) for lines in own for _, t in lines)


def _told(group: list[Capture], signatures: Sequence, most: int) -> Iterator[tuple[dict | str, list[Line], bool, tuple[int | None, str | None] | None]]:
    """What each capture keeps, its lines and whether it ends; and for those whose
    definition isn't known, with all lines held so far, the choice."""
    made: list[tuple[dict | str, list[Line], bool, Head | None]] = []
    for kept, lines, last in group:
        kept, head = {"held": []} if kept is None else kept, None
        if kept != REFUSED and "chosen" not in kept:
            lines = [*(tuple(x) for x in kept["held"]), *lines]
            if sum(_size(t) + 1 for _, t in lines) > most:
                kept = {"beyond": most}
            else:
                head = Head(signatures)
                for _, text in lines:
                    head.add(text)
        made.append((kept, lines, last, head))
    asked = [(head, last) for _, _, last, head in made if head is not None]
    answers = iter(choices([h for h, _ in asked], [last for _, last in asked]))
    for kept, lines, last, head in made:
        yield kept, lines, last, next(answers) if head is not None else None


def chosen(definitions: Sequence[tuple[object, Shape]], most: int):
    """Handles new lines of captures whose definition isn't known: they are held until
    no line that may come changes the choice, and then go the chosen one's way. The
    choice of many captures is told at once."""

    kinds = [kinds_of(shape) for _, shape in definitions]
    names = [f"{s.parser}/{s.variant}" for s, _ in definitions]
    signatures = [s for s, _ in definitions]

    def run(captures: Iterable[Capture]) -> Iterator[tuple[list[tuple], dict | str]]:
        for group, many in _together(captures):
            for kept, lines, last, told in _told(group, signatures, most):
                yield one(kept, lines, last, told, many)

    def one(kept: dict | str, lines: list[Line], last: bool, told: tuple[int | None, str | None] | None, many: Texts | None) -> tuple[list[tuple], dict | str]:
        out: list[tuple] = []
        try:
            if kept != REFUSED and "beyond" in kept:
                raise Refused(f"what waits to be read exceeds {most} bytes")
            if told is not None and told[0] is None:
                raise Refused(told[1])
            if told is not None:
                kept = {"chosen": told[0]}
            elif kept != REFUSED and "held" in kept:
                kept = {"held": lines}
            if kept != REFUSED and "chosen" in kept:
                number = kept["chosen"]
                reader, counts = Reader(definitions[number][1], kept.get("reader"), most, kinds[number], many), kept.get("counts", {})
                for part, own in reader.feed(lines, last):
                    counts[part] = counts.get(part, 0) + 1
                    out.append((names[number], part, counts[part], None, [n for n, _ in own], [t for _, t in own]))
                kept = {} if last else {"chosen": number, "reader": reader.state(), "counts": counts}
        except Refused as why:
            out.append((None, None, 0, str(why), [], []))
            kept = REFUSED
        return out, kept

    return run


UNITS = "part string, nth long, refusal string, nums array<long>, texts array<string>"
REFUSED = "refused"


def handled(shape: Shape, most: int):
    """Handles a bucket's new lines; after a refusal the rest of a capture gives nothing."""
    kinds = kinds_of(shape)

    def run(captures: Iterable[Capture]) -> Iterator[tuple[list[tuple], dict | str]]:
        for group, many in _together(captures):
            for kept, lines, last in group:
                yield one(kept, lines, last, many)

    def one(kept: dict | str | None, lines: list[Line], last: bool, many: Texts | None) -> tuple[list[tuple], dict | str]:
        out: list[tuple] = []
        if kept != REFUSED:
            kept = kept or {}
            reader, counts = Reader(shape, kept.get("reader"), most, kinds, many), kept.get("counts", {})
            try:
                for part, own in reader.feed(lines, last):
                    counts[part] = counts.get(part, 0) + 1
                    out.append((part, counts[part], None, [n for n, _ in own], [t for _, t in own]))
                kept = {} if last else {"reader": reader.state(), "counts": counts}
            except Refused as why:
                out.append((None, 0, str(why), [], []))
                kept = REFUSED
        return out, kept

    return run
