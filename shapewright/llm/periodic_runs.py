"""Periodic runs of words, by tandem repeats in a suffix tree.

After Stoye and Gusfield: where a suffix tree's node has depth D, a leaf i of it
and leaf i + D below another child make a tandem repeat of two times D words
whose next word differs, a branching one. It is enough to look from the leaves
of all children but the largest, in both directions, which are n log n looks in
all. A run's rightmost tandem repeat is branching, so each run is met; rotated to
the left as far as words agree, the repeats become maximal runs, and those of a
multiple of a run's period that end where it does are merged into it.

Many texts share one tree, each ended by a word of its own that none else has. The
tree is held as numpy arrays: suffixes sorted by doubling, in which only ties go
on, what neighbours share, and each node as a range of leaves. A batch of texts
is some ``TOGETHER`` words, or one longer text; it takes some 100 bytes a word
and 4 for each doubling of the longest repeat. Texts are whole always.

Null, empty and blank texts have no words: no runs, four nulls, the hashes of
nothing. Repeated rows each have their row, null ids too. Equal texts have equal runs. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that share a tree.
TOGETHER = 1 << 19
#: Left rotations done for all repeats at once; the few that go on are measured one by one.
STEPS = 8
#: Leaves looked at together.
LOOKS = 1 << 20


def sorted_suffixes(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of ``ids`` in order, and each suffix's rank by its first 1, 2,
    4 ... words, until all differ."""
    n = len(ids)
    order = np.argsort(ids)
    own = ids[order]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks = [rank]
    held = 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of suffixes that no rank tells apart yet
    while len(tied):
        rank = ranks[-1].copy()
        suffix = order[tied]
        next_ = suffix + held
        key = rank[suffix].astype(np.int64) << 32 | np.where(next_ < n, ranks[-1][np.minimum(next_, n - 1)] + 1, 0)
        by = np.argsort(key)  # a group stays in its places, as its rank is the first of them
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        ranks.append(rank)
        tied = tied[~(new & np.append(new[1:], True))]
        held *= 2
    return order, ranks


def shared_lengths(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix shares with the one before it in order; 0 for the first."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    at = np.arange(1, n)
    alike = []
    for rank in ranks:
        at = at[rank[order[at - 1]] == rank[order[at]]]
        alike.append(at)
    for k in range(len(ranks) - 1, -1, -1):
        at = alike[k]
        a, b = order[at - 1] + shared[at], order[at] + shared[at]
        inside = np.maximum(a, b) < n
        at, a, b = at[inside], a[inside], b[inside]
        shared[at[ranks[k][a] == ranks[k][b]]] += 1 << k
    return shared


def _last_smaller(values: np.ndarray) -> np.ndarray:
    """For each place of a value over 0 the last earlier one of a smaller value, or
    -1. All between a place and what is found for it so far are no smaller, so that
    it can jump to what is found for that, and jumps double."""
    found = np.arange(len(values)) - 1
    open_ = np.flatnonzero((values > 0) & (found >= 0))
    while len(open_):
        open_ = open_[values[found[open_]] >= values[open_]]
        found[open_] = found[found[open_]]
        open_ = open_[found[open_] >= 0]
    return found


def branching_repeats(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching tandem repeats of ``ids``, whose last word occurs once."""
    n = len(ids)
    order, ranks = sorted_suffixes(ids)
    shared = shared_lengths(order, ranks)
    del ranks
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # neighbours that share D words are parted within a node of depth D: the leaves around them that share as much
    gap = np.flatnonzero(shared > 0)
    if not len(gap):
        return gap, gap
    first, end = _last_smaller(shared)[gap], n - 1 - _last_smaller(shared[::-1])[::-1][gap]
    by = np.lexsort((gap, shared[gap], first))
    gap, first, end = gap[by], first[by], end[by]
    depth = shared[gap]
    opens = np.concatenate([[True], (first[1:] != first[:-1]) | (depth[1:] != depth[:-1])])
    node = np.cumsum(opens) - 1
    closes = np.append(opens[1:], True)
    # a node's children lie before, between and after its gaps
    left, right = np.empty(len(gap) + node[-1] + 1, np.int64), np.empty(len(gap) + node[-1] + 1, np.int64)
    mine = np.arange(len(gap)) + node
    left[mine], right[mine] = np.where(opens, first, np.concatenate([[0], gap[:-1]])), gap
    left[mine[closes] + 1], right[mine[closes] + 1] = gap[closes], end[closes]
    parent = np.empty(len(left), np.int64)
    parent[mine], parent[mine[closes] + 1] = node, node[closes]
    size = right - left
    largest = np.maximum.reduceat(size, mine[opens])
    full = np.flatnonzero(size == largest[parent])
    small = np.ones(len(left), bool)
    small[full[np.unique(parent[full], return_index=True)[1]]] = False
    child = np.flatnonzero(small)
    first, end, depth = first[opens], end[opens], depth[opens]
    found = []
    ends = np.cumsum(size[child])
    at = 0
    while at < len(child):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKS, "right")))
        some = child[at:upto]
        many = size[some]
        each = np.repeat(some, many)
        leaf = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + left[each]]
        above = parent[each]
        far = depth[above]
        for other, start in ((leaf + far, leaf), (leaf - far, leaf - far)):
            ok = np.flatnonzero((other >= 0) & (other < n))
            there = place[other[ok]]
            hit = (there >= first[above[ok]]) & (there < end[above[ok]]) & ((there < left[each[ok]]) | (there >= right[each[ok]]))
            found.append((start[ok[hit]] << 32) | far[ok[hit]])
        at = upto
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def _agree_before(ids: np.ndarray, a: int, b: int) -> int:
    """How many words before ``a`` and before ``b`` agree, one by one backwards."""
    total, size = 0, 64
    while total < a:
        m = min(size, a - total)
        apart = np.flatnonzero(ids[a - total - m : a - total] != ids[b - total - m : b - total])
        if len(apart):
            return total + m - 1 - int(apart[-1])
        total += m
        size *= 4
    return total


def maximal_runs(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least ``least`` words and
    ``times`` periods, times being 3 or more; ``ids`` ends with a word that occurs once."""
    start, period = branching_repeats(ids)
    need = np.maximum(least, times * period) - 2 * period  # words that must go before the repeat
    going = np.arange(len(start))
    for step in range(1, min(STEPS, int(need.min(initial=STEPS))) + 1):
        going = going[start[going] >= step]
        going = going[ids[start[going] - step] == ids[start[going] + period[going] - step]]
    start, period = start[going], period[going]
    by = np.lexsort((period, start + 2 * period))
    out = []
    last, known = -1, []  # (period, start) of the runs that end where this one does
    for i, p in zip(start[by].tolist(), period[by].tolist(), strict=True):
        end = i + 2 * p
        if end != last:
            last, known = end, []
        if any(p % q == 0 and s <= i for q, s in known):
            continue
        begin = i - _agree_before(ids, i, i + p)
        known.append((p, begin))
        if end - begin >= max(least, times * p):
            out.append((begin, end - begin, p))
    return sorted(out)


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words with the stretch that the number ``h`` asks for: from word a on,
    those of the first p repeat."""
    n = len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def texts_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words; all share one tree."""
    lengths = np.array([len(t) for t in texts], np.int64)
    words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    ids = np.empty(lengths.sum() + len(texts), np.int64)
    ends = np.cumsum(lengths + 1) - 1
    ids[ends] = len(words.dictionary) + np.arange(len(texts))
    inner = np.ones(len(ids), bool)
    inner[ends] = False
    ids[inner] = words.indices.to_numpy()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in maximal_runs(ids) if len(ids) > 1 else []:
        k = int(np.searchsorted(ends, start))
        out[k].append((start - int(ends[k] - lengths[k]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without the repeats of each run, joined by a space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(plant: bool):
    def told(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = texts_runs(texts)
        named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
        rest = pa.array([collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(named, _RUNS), rest], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own = doc_id.as_py()
                words = (text.as_py() or "").encode().split()  # bytes: at the six blanks alone
                if plant and own is not None:
                    words = planted(words, zlib.crc32(str(own).encode()))
                if texts and held + len(words) > TOGETHER:
                    yield told(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(own)
                texts.append(words)
                held += len(words)
        if texts:
            yield told(ids, texts)

    return run


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``: its maximal
    runs by start and period, and its words without their repeats. With ``plant``
    a text is altered first as ``planted`` says, by the CRC-32 of its id; one
    without id stays as it is."""
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(_found(plant), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` as (doc_id, n_runs, the run of most periods, SHA-256 of the runs and of the collapsed text)."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
