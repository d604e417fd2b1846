"""Near copies by the similarity of five-word shingles, and one row of each group.

Two texts link where their sets of five-word shingles have a Jaccard similarity
of 0.8 or more; repeats of a shingle don't count. SimHashes of 64 bits differ at
that similarity in some ten bits (3 standard deviations: 18), a radius at which
agreeing blocks of bits tell no two texts apart. So what is compared is filed by
bands of least hashes instead, BANDS of DEEP each, and compared bit plane by bit
plane as in ``simhash``, at a radius of RADIUS bits. A pair at 0.8 is filed
apart with a chance of (1 - 0.8^DEEP)^BANDS, 3 in a million, and beyond the
radius with one of about as much, whatever the size of the corpus.

Whatever is linked lies in one component of the candidates. Each component's
sets meet in a task, where links are decided exactly from the whole sets. A
component of over ``largest`` shingles is cut by hash, and every two of its
cuts meet in a task.

Texts: white space and the case of A-Z don't count; a text of fewer than five
words is one shingle; null and blank texts have none and are copies of each
other. Equal sets are one node, named by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_row_each, row_key, settle
from .components import components
from .simhash import filed_links, fingerprint_of

SEED = 42
WORDS = 5
BANDS, DEEP = 32, 5
#: Differing bits at which fingerprints of texts of a similarity of 0.8 still meet.
RADIUS = 24
#: Shingles that a task holds at a time, about.
LARGEST = 2_000_000

_DRAWN = np.random.default_rng(SEED)
_FACTORS = _DRAWN.integers(0, 1 << 32, BANDS * DEEP, np.uint32) | np.uint32(1)
_MIX = _DRAWN.integers(0, 1 << 63, (BANDS, DEEP), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _DRAWN.integers(0, 1 << 63, BANDS, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    spans = [(0, len(joined))] if len(parts) < words else zip([0, *ends], [e - 1 for e in ends[words - 1 :]], strict=False)
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), (1 << 32) - 1, np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(least, (_FACTORS[:, None] * short[None, at : at + 4096]).min(axis=1), out=least)
    return ((least.reshape(BANDS, DEEP).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def node_of(own: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py() or "") for t in batch.column(2)]
        keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
        nodes, sizes = pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
        fps = pa.array(np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, sizes, fps, keys], names=["row_key", "doc_id", "node", "size", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingles(t.as_py() or "").tobytes() for t in batch.column(3)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), sets], names=["component", "node", "cuts", "shingles"])


def similar_links(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links enough to join what pairs of a similarity of 0.8 or more join.

    A set is held against all that nothing has reached yet, by how many of its
    shingles each has; what it reaches is held against the rest in its turn.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, codes, shared = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(codes, kind="stable")
    order = order[shared[codes[order]] > 1]  # what one set alone has joins nothing
    code, owner = codes[order], owner[order]
    left, packed = np.ones(n, bool), n
    starts = np.searchsorted(code, np.arange(len(shared) + 1))
    us: list[int] = []
    vs: list[int] = []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        waiting = [seed]
        while waiting:
            i = waiting.pop()
            if 2 * (now := int(left.sum())) < packed:  # what is reached goes from the lists
                stays = left[owner]
                code, owner, packed = code[stays], owner[stays], now
                starts = np.searchsorted(code, np.arange(len(shared) + 1))
            a, many = starts[own[i]], starts[own[i] + 1] - starts[own[i]]
            if not many.any():
                continue
            places = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(owner[places], minlength=n)
            reached = np.flatnonzero(left & (common > 0) & (9 * common >= 4 * (sizes[i] + sizes)))
            left[reached] = False
            waiting += reached.tolist()
            us += [i] * len(reached)
            vs += reached.tolist()
    return us, vs


def _confirmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each group; frames come sorted by group."""
    group = ["component", "one", "two"]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for _, rows in part.groupby(group, sort=False):
            names = rows["node"].to_numpy(np.int64)
            i, j = similar_links([np.frombuffer(b, np.uint64) for b in rows["shingles"]])
            u.append(names[np.array(i, np.int64)])
            v.append(names[np.array(j, np.int64)])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        if held and (frame[group].iloc[0] != held[-1][group].iloc[-1]).any():
            yield work(pd.concat(held, ignore_index=True))
            held = []
        last = (frame[group] == frame[group].iloc[-1]).all(axis=1).to_numpy()
        if not last.all():
            yield work(pd.concat([*held, frame[~last]], ignore_index=True))
            held = []
        held.append(frame[last])
    if held:
        yield work(pd.concat(held, ignore_index=True))


def groups(docs: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(row_key, doc_id, component) of every row: rows of a component are near
    copies of each other, at once or by way of others."""
    keyed = docs.select(row_key(docs).alias("row_key"), "doc_id", "text")
    own = settle(keyed.mapInArrow(_described, "row_key long, doc_id long, node long, size long, fp long, keys array<long>"))
    nodes = settle(own.groupBy("node").agg(F.min("row_key").alias("row_key"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    filed = nodes.select(F.col("node").alias("name"), "fp", F.posexplode("keys").alias("table", "key"))
    met = settle(filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    near = components(filed_links(settle(filed.join(met, "key")), RADIUS))
    near = settle(nodes.select("node", "row_key", "size").join(near, "node"))
    crowded = near.groupBy("component").agg(F.sum("size").alias("all")).filter(F.col("all") > largest).select("component", F.ceil(2 * F.col("all") / largest).cast("int").alias("cuts"))
    near = near.join(crowded, "component", "left").select("component", "node", F.coalesce("cuts", F.lit(1)).alias("cuts"), "row_key")
    texts = docs.select(row_key(docs).alias("row_key"), "text").join(near.hint("merge"), "row_key").select("component", "node", "cuts", "text")
    sets = texts.mapInArrow(_sets, "component long, node long, cuts int, shingles binary")
    cut = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    met = sets.select("component", "node", "cuts", "shingles", cut.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")).filter("cuts = 1 or own <> other")
    met = met.select("component", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node", "shingles")
    dealt = met.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two")
    found = components(dealt.mapInPandas(_confirmed, "u long, v long"))
    return own.select("row_key", "doc_id", "node").join(found, "node", "left").select("row_key", "doc_id", F.coalesce("component", "node").alias("component"))


def one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    return one_row_each(docs, settle(groups(docs)))
