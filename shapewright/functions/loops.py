"""Which repeats of a pattern can be possessive without a change of what matches.

The JVM's matcher goes one level deeper in its stack with each round of a
repeated group that it may have to take back, and a stack that runs over ends the
executor. A possessive group is repeated without that. It matches the same where
the next character alone tells which way a match goes on: after any character of
the group, and after the group, no two ways begin alike. ``survey`` reads a
pattern's ways (the characters that may follow each of its characters) and tells
which repeated groups are such. A pattern that has another one is ``deep``: its
matches are found by a linear-time engine instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field

Ranges = list[tuple[int, int]]
TOP = 0x10FFFF
ALL: Ranges = [(-1, TOP)]
#: The end of the text, as a character.
END_OF_TEXT: Ranges = [(-1, -1)]
#: Rounds up to which a repeat's depth doesn't matter.
FEW = 16
#: Levels of the stack that may be used, of some 100 bytes, and those of a round besides its characters.
LEVELS, EACH = 5000, 6
#: The dialect's classes.
CLASSES: dict[str, Ranges] = {"d": [(48, 57)], "w": [(48, 57), (65, 90), (95, 95), (97, 122)], "s": [(9, 10), (12, 13), (32, 32)]}
POSIX: dict[str, Ranges] = {
    "alnum": [(48, 57), (65, 90), (97, 122)], "alpha": [(65, 90), (97, 122)], "ascii": [(0, 127)], "blank": [(9, 9), (32, 32)], "cntrl": [(0, 31), (127, 127)],
    "digit": [(48, 57)], "graph": [(33, 126)], "lower": [(97, 122)], "print": [(32, 126)], "punct": [(33, 47), (58, 64), (91, 96), (123, 126)],
    "space": [(9, 13), (32, 32)], "upper": [(65, 90)], "word": [(48, 57), (65, 90), (95, 95), (97, 122)], "xdigit": [(48, 57), (65, 70), (97, 102)],
}
_NAMED = {"t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "a": 7}


def _others(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for a, b in sorted(ranges):
        if a > at:
            out.append((at, a - 1))
        at = max(at, b + 1)
    return [*out, (at, TOP)] if at <= TOP else out


def _either_case(ranges: Ranges) -> Ranges:
    """More than the characters that fold together, to be safe."""
    if any(b > 127 for _, b in ranges):
        return ALL
    out = list(ranges)
    for a, b in ranges:
        for low, high, move in ((65, 90, 32), (97, 122, -32)):
            if max(a, low) <= min(b, high):
                out.append((max(a, low) + move, min(b, high) + move))
    return [*out, (128, TOP)] if any(a <= c <= b for a, b in out for c in (107, 115)) else out


def _apart(sets: list[Ranges]) -> bool:
    """Whether no two of the sets share a character."""
    spans = sorted((a, b, k) for k, ranges in enumerate(sets) for a, b in ranges)
    most, owner = -2, -1
    for a, b, k in spans:
        if a <= most and k != owner:
            return False
        if b > most:
            most, owner = b, k
    return True


@dataclass
class _Part:
    """A piece of a pattern: the fewest characters it takes, and the places it begins and ends with."""

    least: int = 0
    first: set[int] = field(default_factory=set)
    last: set[int] = field(default_factory=set)

    @property
    def empty(self) -> bool:
        return not self.least


@dataclass(frozen=True)
class Survey:
    """``possessive`` tells for the index after a repeated group's quantifier, or
    of the question mark that makes it lazy, that it can be possessive."""

    possessive: frozenset[int]
    deep: bool
    #: Characters that a deep pattern can take without running over a stack of a megabyte.
    most: int = 0


class _Reader:
    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.sets: list[Ranges] = []
        self.follow: list[set[int]] = []
        self.loops: list[tuple[range, _Part, bool, int]] = []  # places, what is repeated, lazy, index
        self.open: set[int] = set()  # numbers of loops whose rounds' ends are open
        self.flags: frozenset[str] = frozenset()

    def place(self, ranges: Ranges) -> _Part:
        self.sets.append(_either_case(ranges) if "i" in self.flags else ranges)
        self.follow.append(set())
        return _Part(1, {len(self.sets) - 1}, {len(self.sets) - 1})

    def choice(self) -> _Part:
        flags = self.flags
        found = self.sequence()
        while self.source.startswith("|", self.at):
            self.at += 1
            more = self.sequence()
            found = _Part(min(found.least, more.least), found.first | more.first, found.last | more.last)
        self.flags = flags
        return found

    def sequence(self) -> _Part:
        found = _Part()
        while self.at < len(self.source) and self.source[self.at] not in "|)":
            begun = len(self.sets)
            part, single = self.item()
            part = self.repeated(part, range(begun, len(self.sets)), single)
            for p in found.last:
                self.follow[p] |= part.first
            found = _Part(found.least + part.least, found.first | part.first if found.empty else found.first, found.last | part.last if part.empty else part.last)
        return found

    def repeated(self, part: _Part, places: range, single: bool) -> _Part:
        while self.at < len(self.source):
            c = self.source[self.at]
            least, most, end = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(c, (1, 1)) + (self.at + 1,)
            if c == "{":
                close = self.source.find("}", self.at)
                counts = self.source[self.at + 1 : close].split(",") if close > 0 else []
                if not counts or len(counts) > 2 or not counts[0].isdigit() or not (counts[-1].isdigit() or (len(counts) == 2 and not counts[1])):
                    return part
                least, most, end = int(counts[0]), int(counts[-1]) if counts[-1] else None, close + 1
            elif c not in "*+?":
                return part
            lazy = self.source.startswith("?", end)
            if most is None or most > 1:
                # rounds that are counted, of what goes round by itself: where one ends is open
                open_ends = (least > 1 or most is not None) and any(self.follow[p] & part.first for p in part.last)
                for p in part.last:
                    self.follow[p] |= part.first
                if open_ends:  # then what goes round inside may have to stop early
                    self.open.update(k for k, loop in enumerate(self.loops) if loop[0].start >= places.start)
                # rounds that can be empty end differently in either engine, however few they are
                if not single and (most is None or most > FEW or part.empty):
                    self.open.update([len(self.loops)] * open_ends)
                    self.loops.append((places, part, lazy, end))
            part = _Part(part.least * least, part.first, part.last)
            self.at = end + lazy
            single = False
        return part

    def item(self) -> tuple[_Part, bool]:
        c = self.source[self.at]
        self.at += 1
        if c == "(":
            return self.group(), False
        if c == "[":
            return self.place(self.bracket()), True
        if c == ".":
            return self.place([(0, TOP)] if "s" in self.flags else [(0, 9), (11, TOP)]), True
        if c == "$":
            return self.place([*END_OF_TEXT, (10, 10)] if "m" in self.flags else END_OF_TEXT), True
        if c == "^":
            return self.place(ALL), True
        if c == "\\":
            if self.source[self.at : self.at + 1] == "z":
                self.at += 1
                return self.place(END_OF_TEXT), True
            return self.place(self.escape()), True
        return self.place([(ord(c), ord(c))]), True

    def group(self) -> _Part:
        flags, rest = self.flags, self.source[self.at :]
        if rest.startswith(("?P<", "?<")):
            self.at = self.source.index(">", self.at) + 1
        elif rest.startswith("?"):
            end = next(k for k in range(self.at, len(self.source)) if self.source[k] in ":)")
            on, _, off = self.source[self.at + 1 : end].partition("-")
            self.flags = (self.flags | set(on)) - set(off)
            self.at = end + 1
            if self.source[end] == ")":  # for what follows in the group around
                return _Part()
        found = self.choice()
        if not self.source.startswith(")", self.at):
            raise ValueError("a parenthesis that isn't closed")
        self.at += 1
        self.flags = flags
        return found

    def escape(self) -> Ranges:
        c = self.source[self.at]
        self.at += 1
        if c.lower() in CLASSES:
            return CLASSES[c] if c in CLASSES else _others(CLASSES[c.lower()])
        if c in _NAMED:
            return [(_NAMED[c], _NAMED[c])]
        if c == "x":
            end = self.source.index("}", self.at) if self.source.startswith("{", self.at) else self.at + 2
            value = int(self.source[self.at : end].lstrip("{"), 16)
            self.at = end + self.source.startswith("}", end)
            return [(value, value)]
        if c in "pP":
            self.at = self.source.index("}", self.at) + 1 if self.source.startswith("{", self.at) else self.at + 1
            return ALL
        if c.isalnum():
            return ALL  # \\b, \\A and what else looks at more than a character
        return [(ord(c), ord(c))]

    def bracket(self) -> Ranges:
        denied = self.source.startswith("^", self.at)
        self.at += denied
        found: Ranges = []
        begun = self.at
        while self.at == begun or not self.source.startswith("]", self.at):
            c = self.source[self.at]
            if self.source.startswith("[:", self.at):
                end = self.source.index(":]", self.at)
                name = self.source[self.at + 2 : end]
                found += _others(POSIX[name[1:]]) if name.startswith("^") else POSIX[name]
                self.at = end + 2
                continue
            self.at += 1
            one = self.escape() if c == "\\" else [(ord(c), ord(c))]
            if self.source.startswith("-", self.at) and not self.source.startswith("-]", self.at) and len(one) == 1 and one[0][0] == one[0][1]:
                self.at += 2
                to = self.source[self.at - 1]
                one = [(one[0][0], self.escape()[0][1] if to == "\\" else ord(to))]
            found += one
        self.at += 1
        if "i" in self.flags:
            found = _either_case(found)
        return (ALL if (-1, TOP) in found else _others(found)) if denied else found


def survey(source: str) -> Survey:
    """What is known of a pattern's repeated groups."""
    reader = _Reader(source)
    try:
        whole = reader.choice()
        if reader.at < len(source):
            raise ValueError("a parenthesis that none opens")
    except (ValueError, IndexError, KeyError, StopIteration):
        return Survey(frozenset(), True, LEVELS // 100)
    done = len(reader.sets)  # the end of the match, which begins like nothing
    for p in whole.last:
        reader.follow[p].add(done)
    sets = [*reader.sets, []]
    good, levels = set(), 0.0  # levels for each character
    for k, (places, part, lazy, index) in enumerate(reader.loops):
        told = not part.empty and k not in reader.open and _apart([sets[p] for p in part.first]) and all(_apart([sets[q] for q in reader.follow[p]]) for p in places)
        if told and not (lazy and any(done in reader.follow[p] for p in part.last)):
            good.add(index)
        else:
            levels += (len(places) + EACH) / max(part.least, 1)
    return Survey(frozenset(good), levels > 0, int(LEVELS / levels) if levels else 0)
