"""Which of many signatures fit texts, and when a choice can't change any more.

``fitting`` takes a batch of windows. One pass of an automaton over each tells
which of the texts that the patterns require are in it; a pattern is matched, by
Arrow's linear-time kernels, only against windows that hold what it requires.
``Head`` takes one text's lines as they come; ``choices``
tells the choice of many such heads at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.patterns import translate
from ..functions.text import WHITE

try:
    import ahocorasick
except ImportError:  # then each text is looked for by itself
    ahocorasick = None


def linear(pattern: str) -> str:
    """A signature's pattern for Arrow's kernels: lines begin and end anywhere in it, unless it has flags of its own."""
    return translate("(?m)" + pattern if not pattern.startswith("(?") else pattern).linear


def _holding(texts: pa.Array, wanted: Sequence[str]) -> dict[str, np.ndarray]:
    """For each wanted text the numbers of the texts that hold it."""
    if ahocorasick is None or len(wanted) < 8:
        return {w: np.flatnonzero(pc.match_substring(texts, w).to_numpy(zero_copy_only=False)) for w in wanted}
    automaton = ahocorasick.Automaton()
    for w in wanted:
        automaton.add_word(w, w)
    automaton.make_automaton()
    found: dict[str, list[int]] = {w: [] for w in wanted}
    for k, text in enumerate(texts.to_pylist()):
        for w in {w for _, w in automaton.iter(text)}:
            found[w].append(k)
    return {w: np.array(at, np.int64) for w, at in found.items()}


def fitting(windows: dict[int, pa.Array], signatures: Sequence[tuple[int, tuple[str, ...], tuple[str, ...], tuple[str, ...]]], required: Callable[[str], str]) -> list[list[int]]:
    """For each text the numbers of the signatures (window, all, any, none) that fit
    it. ``windows`` has the texts cut to each length."""
    size = len(next(iter(windows.values())))
    out: list[list[int]] = [[] for _ in range(size)]
    holding, hits = {}, {}
    for n, texts in windows.items():
        mine = {p for s in signatures if s[0] == n for kind in s[1:] for p in kind}
        wanted = sorted({w for p in mine if len(w := required(p)) > 1})
        holding[n] = _holding(texts, wanted)

    def where(n: int, pattern: str, among: np.ndarray) -> np.ndarray:
        """Those of some texts that a pattern matches."""
        need = required(pattern)
        if len(need) > 1:
            among = np.intersect1d(among, holding[n][need], assume_unique=True)
        if not len(among):
            return among
        if (n, pattern) not in hits and len(among) * 4 > size:  # then other signatures' turn may come as well
            hits[n, pattern] = np.flatnonzero(pc.match_substring_regex(windows[n], linear(pattern)).to_numpy(zero_copy_only=False))
        if (n, pattern) in hits:
            return np.intersect1d(among, hits[n, pattern], assume_unique=True)
        return among[pc.match_substring_regex(windows[n].take(pa.array(among)), linear(pattern)).to_numpy(zero_copy_only=False)]

    for number, (n, all_, any_, none) in enumerate(signatures):
        left = np.arange(size)
        for p in sorted(all_, key=lambda p: -len(required(p))):
            left = where(n, p, left)
        if any_ and len(left):
            left = np.unique(np.concatenate([where(n, p, left) for p in any_]))
        for p in none:
            left = np.setdiff1d(left, where(n, p, left), assume_unique=True)
        for k in left.tolist():
            out[k].append(number)
    return out


def _stays(pattern: str) -> bool:
    """Whether a match in some first lines is one in whatever follows them: a pattern that looks at the text's end may not."""
    flags = pattern[2 : pattern.find(")")] if pattern.startswith("(?") and not pattern.startswith(("(?:", "(?P", "(?<")) else "m"
    return r"\z" not in pattern and ("$" not in pattern or "m" in flags.split("-")[0].split(":")[0])


#: Whether a definition fits whatever follows, doesn't, or neither is sure.
NOT, FITS, OPEN = 0, 1, 2


class Head:
    """The first lines of a text, until the choice among signatures can't change."""

    def __init__(self, signatures: Sequence, lines: Sequence[str] = ()):
        self.signatures, self.lines = list(signatures), list(lines)

    def add(self, text: str) -> None:
        if self.lines or text.strip(WHITE):
            self.lines.append(text.removesuffix("\r"))

    def choice(self, ended: bool) -> tuple[int | None, str | None] | None:
        """(number of the definition, or why there is none) once no line that may
        come changes it; None before. Definitions that are open and can't beat, or
        vie with, the best that fits are not waited for."""
        return choices([self], [ended])[0]

    def _settled(self, told: Sequence[int]) -> tuple[int | None, str | None] | None:
        """The choice, told of each definition whether it fits."""
        fits = [k for k, t in enumerate(told) if t == FITS]
        open_ = [k for k, t in enumerate(told) if t == OPEN]
        if not fits:
            return None if open_ else (None, "no definition matches")
        first = min(self.signatures[k].source for k in fits)
        if any(self.signatures[k].source < first for k in open_):
            return None
        same = [k for k in fits if self.signatures[k].source == first]
        rivals = [k for k in open_ if self.signatures[k].source == first]
        best = max(same, key=lambda k: self.signatures[k].priority)
        most = self.signatures[best].priority
        one = lambda ks: len({self.signatures[k].parser for k in ks}) <= 1
        if rivals and not (one(same + rivals) and all(self.signatures[k].priority < most for k in rivals)):
            return None
        alone = len(same) == 1 or (one(same) and sum(self.signatures[k].priority == most for k in same) == 1)
        names = sorted(f"{self.signatures[k].parser}/{self.signatures[k].variant}" for k in same)
        return (best, None) if alone else (None, "ambiguous: " + ", ".join(names))


def choices(heads: Sequence[Head], ended: Sequence[bool]) -> list[tuple[int | None, str | None] | None]:
    """``Head.choice`` of many heads under the same signatures: a pattern is matched
    against all their windows at once."""
    if not heads:
        return []
    signatures = heads[0].signatures
    windows = {n: pa.array(["\n".join(h.lines[:n]).rstrip("\n") for h in heads], pa.string()) for n in {s.window for s in signatures}}
    sizes, over = np.array([len(h.lines) for h in heads]), np.array(ended, bool)
    found: dict[tuple[int, str], np.ndarray] = {}

    def hit(n: int, pattern: str) -> np.ndarray:
        if (n, pattern) not in found:
            found[n, pattern] = pc.match_substring_regex(windows[n], linear(pattern)).to_numpy(zero_copy_only=False)
        return found[n, pattern]

    def of_all(n: int, patterns: Sequence[str]) -> np.ndarray:
        left = np.ones(len(heads), bool)
        for p in patterns:
            if left.any():
                left = left & hit(n, p)
        return left

    def of_any(n: int, patterns: Sequence[str]) -> np.ndarray:
        met = np.zeros(len(heads), bool)
        for p in patterns:
            if not met.all():
                met = met | hit(n, p)
        return met

    told = np.empty((len(heads), len(signatures)), np.int8)
    for k, s in enumerate(signatures):
        n, full = s.window, over | (sizes > s.window)
        fits = of_all(n, s.all)
        if s.any and fits.any():
            fits = fits & of_any(n, s.any)
        if s.none and (fits & full).any():
            fits = fits & ~(of_any(n, s.none) & full)
        told[:, k] = np.where(fits, FITS, NOT)
        if not full.all():
            never = of_any(n, [p for p in s.none if _stays(p)])
            sure = not s.none and all(map(_stays, s.all))
            some = [p for p in s.any if _stays(p)]
            sure = of_all(n, s.all) & (of_any(n, some) if s.any else True) if sure else np.zeros(len(heads), bool)
            told[~full, k] = np.where(never, NOT, np.where(sure, FITS, OPEN))[~full]
    settled: dict[bytes, tuple[int | None, str | None] | None] = {}
    keys = [row.tobytes() for row in told]
    for key in set(keys):
        settled[key] = heads[0]._settled(list(key))
    return [settled[key] for key in keys]
