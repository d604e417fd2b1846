"""SimHash near-duplicates by comparing bit planes.

A fingerprint has a bit for each of 64 places, set if it is set in over half of
the hashes of the text's word shingles. Fingerprints link at a few differing
bits. Two that differ in at most r of 64 bits agree on b - r of any b blocks of
bits, so each distinct fingerprint is filed under every choice of b - r blocks
and only those filed alike are compared; none that link are missed.

A task lays the fingerprints it compares out as 64 bit planes, one bit a lane,
sorted by group. Lane i is set against lane i + 1, then i + 2 and so on, 64
lanes a machine word: differing bits are counted by carry-save adders, and a
word is left out once each of its lanes is beyond the radius or out of its
group. A group of over ``largest`` fingerprints is cut by hash, and every two
of its cuts meet in a task.

Texts: null and blank texts have the fingerprint zero and link like any other;
very long texts are read whole; equal texts have equal fingerprints, of which
one is compared. An empty table gives no rows. Columns other than the id and
the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_row_each, row_key, settle
from .components import components

SEED = 42
#: Lanes that a task compares at a time, at least.
LANES = 1 << 16


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes: the bits that over half of them have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, words: int = 4) -> int:
    """The fingerprint of one text, unsigned."""
    parts = text.encode().lower().split()  # bytes: A-Z alone, and the six blanks alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    if len(parts) < words:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *ends], [e - 1 for e in ends[words - 1 :]], strict=False)
    return fingerprint_of(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _keyed(words: int):
    """Fingerprints beside the key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", words) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["row_key", "doc_id", "fp"])

    return run


def close_lanes(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the pairs within ``radius`` bits and one group, distance of
    lanes by distance of lanes. ``group`` is sorted; radius is at most 62."""
    height = max(radius.bit_length(), 3)  # counters of so many bits, and one more for what they can't hold
    n = len(fps)
    words = -(-n // 64)
    bits = np.zeros((64, (words + 2) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    del bits
    lag = 0
    while True:
        lag += 1
        same = np.zeros(words * 64, np.uint8)
        if lag < n:
            same[: n - lag] = group[lag:] == group[:-lag]
        alive = np.packbits(same, bitorder="little").view(np.uint64)
        at = np.flatnonzero(alive)
        if not len(at):
            return
        alive = alive[at]
        hop, low = divmod(lag, 64)
        counter = [np.zeros(len(at), np.uint64) for _ in range(height)]
        more = np.zeros(len(at), np.uint64)
        for first in range(0, 64, 8):
            for b in range(first, first + 8, 2):
                x, y = (planes[k][at] ^ (planes[k][at + hop] if not low else (planes[k][at + hop] >> np.uint64(low)) | (planes[k][at + hop + 1] << np.uint64(64 - low))) for k in (b, b + 1))
                half = x ^ y
                carry = (x & y) | (half & counter[0])  # a full adder of two planes and the ones
                counter[0] = counter[0] ^ half
                for k in range(1, height):
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
                more = more | carry
            # beyond: the highest bit in which a count and the radius differ is the count's
            beyond, equal = more.copy(), ~more
            for k in range(height - 1, -1, -1):
                if radius >> k & 1:
                    equal &= counter[k]
                else:
                    beyond |= equal & counter[k]
                    equal &= ~counter[k]
            alive = alive & ~beyond
            left = np.flatnonzero(alive)
            if len(left) < len(at):
                at, alive, more = at[left], alive[left], more[left]
                counter = [c[left] for c in counter]
            if not len(at):
                break
        if len(at):
            lanes = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
            i = at[lanes // 64] * 64 + lanes % 64
            yield i, i + lag


def spanning_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to join what pairs within the radius join: at most one a lane."""
    root = np.arange(len(fps))
    for i, j in close_lanes(fps, group, radius):
        apart = root[i] != root[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            root[max(a, b)] = min(a, b)
        if apart.any():
            while not np.array_equal(above := root[root], root):
                root = above
    held = np.flatnonzero(root != np.arange(len(fps)))
    return held, root[held]


def _linked(radius: int):
    """Links between the names of fingerprints; frames come sorted by group."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        key = part[["table", "key", "one", "two"]].to_numpy(np.int64)
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
        names = part["name"].to_numpy()
        i, j = spanning_links(part["fp"].to_numpy(np.int64).view(np.uint64), group, radius)
        return pd.DataFrame({"u": names[i], "v": names[j]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < LANES:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole.iloc[-1]
            open_from = int((whole[["table", "key", "one", "two"]] != last[["table", "key", "one", "two"]]).any(axis=1).to_numpy().nonzero()[0].max(initial=-1)) + 1
            if open_from:
                yield work(whole.iloc[:open_from])
            held = [whole.iloc[open_from:]]
        if held and len(whole := pd.concat(held, ignore_index=True)):
            yield work(whole)

    return run


def blocks_for(rows: int, radius: int) -> int:
    """Blocks of bits so that what is agreed on tells about as many rows apart."""
    for blocks in range(radius + 2, radius + 7):
        if 64 * (blocks - radius) / blocks >= np.log2(max(rows, 2)) + 2:
            break
    return blocks


def fingerprint_links(nodes: DataFrame, radius: int = 4, blocks: int = 6, largest: int = 4096) -> DataFrame:
    """(u, v) over the names in ``nodes`` (name long, fp long, distinct): links
    that join whatever fingerprints within ``radius`` bits join."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for chosen in combinations(masks, blocks - radius):
        mask = sum(chosen)
        keys.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)))
    return filed_links(nodes.select("name", "fp", F.posexplode(F.array(*keys)).alias("table", "key")), radius, largest)


def filed_links(filed: DataFrame, radius: int, largest: int = 4096) -> DataFrame:
    """(u, v) over the names in ``filed`` (name, fp, table, key): links that join
    whatever is filed alike, under a table and a key, within ``radius`` bits."""
    crowded = filed.groupBy("table", "key").count().filter(F.col("count") > largest).select("table", "key", F.ceil(F.col("count") / (largest // 2)).cast("int").alias("cuts"))
    parts = F.coalesce("cuts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    met = filed.join(crowded, ["table", "key"], "left").select("table", "key", "name", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    met = met.select("table", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "name", "fp")
    dealt = met.repartition("table", "key", "one", "two").sortWithinPartitions("table", "key", "one", "two")
    return dealt.mapInPandas(_linked(radius), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every document: component_id is the
    smallest id that links lead to, null where they lead to none."""
    own = settle(fingerprints(docs, words))
    nodes = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    blocks = blocks_for(nodes.count(), radius)
    assert comb(blocks, blocks - radius) <= 210
    links = fingerprint_links(nodes.select(F.col("fp").alias("name"), "fp"), radius, blocks)
    found = components(links).withColumnRenamed("node", "fp")
    # a component is known by a fingerprint of its own until its smallest id is; that is null where no row has one
    rooted = settle(nodes.join(found, "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = settle(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"))
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def one_each(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the
    smallest id, null ids last; of rows that repeat it one."""
    keyed = settle(docs.select(row_key(docs).alias("row_key"), "doc_id", F.col("text")).mapInArrow(_keyed(words), "row_key long, doc_id long, fp long"))
    nodes = settle(keyed.select("fp").distinct())
    links = fingerprint_links(nodes.select(F.col("fp").alias("name"), "fp"), radius, blocks_for(nodes.count(), radius))
    found = components(links).withColumnRenamed("node", "fp")
    return one_row_each(docs, keyed.join(found, "fp", "left").select("row_key", "doc_id", F.coalesce("component", "fp").alias("component")))
