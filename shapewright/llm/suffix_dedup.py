"""Removal of repeated byte strings by blockwise suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else
in the corpus too. Such strings are the suffixes, to that depth, that come out
equal when suffixes are sorted; they are sorted one bucket at a time.

Buckets. The bucket of a suffix is the rarest-looking ``KMER`` bytes in its
first ``LENGTH``: those of the smallest hash, the leftmost if several. Equal
strings agree on it and on where it stands in them, so they share a bucket, and
the suffixes of a bucket that follow each other in a text are one run, kept as
one row. Runs in buckets that nothing else falls into are dropped; runs that
are equal as a whole repeat with all their suffixes; the rest are sorted.

Sorting. The runs of some buckets are laid out in a block of bounded size, each
with its anchor at a multiple of the period of a difference cover. Positions in
the cover are ranked first, by doubling. A bucket's suffixes are sorted by their
first bytes, and ties are resolved by the ranks of the cover samples that follow
within a period, so no comparison reads a long tie through.

A bucket of over ``LARGEST`` runs that differ isn't sorted in one task: its runs
are cut into chunks that are filed by what their suffixes share, and chunks that
neither repeat as a whole nor stand alone are cut again, down to one suffix.

Texts: null counts as empty; texts shorter than LENGTH keep all bytes. Very long
texts are read whole. Repeated rows are copies of each other, so at LENGTH bytes
or more all of them go. A row without an id is a document like any other. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

LENGTH = 400
KMER = 32
#: A difference cover of period 16: any two positions have a common shift into it.
PERIOD = 16
COVER = (0, 1, 2, 5, 8)
#: Runs that differ, of a bucket that one task sorts.
LARGEST = 1024
#: Equal runs beyond which their key isn't joined by a shuffle. A task's share of a
#: join is then some thousand rows, or the keys are so many that they are spread.
HOT = 2048
#: Suffixes in a chunk of a run of a crowded bucket, from one step to the next.
CHUNKS = (32, 4, 1)
#: Bytes that a task lays out at a time, about.
BLOCK = 1 << 20

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as an integer, first byte highest."""
    return np.ndarray(len(data) - 7, ">u8", data, strides=(1,)).astype(np.uint64)


def _mixed(x: np.ndarray, y: np.ndarray, k: int = 0) -> np.ndarray:
    z = (x ^ (x >> np.uint64(29))) * _MIX[k] + y
    z ^= z >> np.uint64(32)
    z *= _MIX[k + 1]
    z ^= z >> np.uint64(29)
    return z


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts) + bytes(LENGTH + 64), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each run of suffixes of one bucket: text, first start, last start,
    anchor (all within the text), and the bucket."""
    data, bounds = _joined(texts)
    n = int(bounds[-1])
    words = _words(data)
    hashed = _mixed(_mixed(words[: n + 32], words[8 : n + 40]), _mixed(words[16 : n + 48], words[24 : n + 56]), 2)
    least = (hashed >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashed), dtype=np.uint64)
    wide, whole = 1, LENGTH - KMER + 1
    while 2 * wide <= whole:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.concatenate([least, np.full(whole, ~np.uint64(0))])
    starts = [np.arange(a, b - LENGTH + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a >= LENGTH]
    if not starts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    start = np.concatenate(starts)
    anchor = (np.minimum(least[start], least[start + whole - wide]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(start)) - 1
    text = np.searchsorted(bounds, start[first], "right") - 1
    base = bounds[text]
    return text, start[first] - base, start[last] - base, anchor[first] - base, hashed[anchor[first]].view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = batch.column(0), batch.column(1)
        texts = [(t.as_py() or "").encode() for t in batch.column(2)]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            text, low, high, anchor, bucket = runs_of(part)
            whole = np.array([xxhash.xxh3_64_intdigest(part[t][a : b + LENGTH], c - a) for t, a, b, c in zip(text.tolist(), low.tolist(), high.tolist(), anchor.tolist(), strict=True)], np.uint64)
            rows = pa.array(text + at)
            yield pa.RecordBatch.from_arrays([ids.take(rows), marks.take(rows), pa.array(bucket), pa.array(whole.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (low, high, anchor)]], names=["d", "t", "bucket", "whole", "low", "high", "anchor"])
            at = end


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted run of a text."""
    names = ["d", "t", "bucket", "crowded", "alone", "low", "anchor", "n", "data"]
    for batch in batches:
        for k in range(batch.num_rows):
            text = (batch.column(2)[k].as_py() or "").encode()
            wanted = batch.column(3)[k].as_py()
            columns = [[w[c] for w in wanted] for c in ("bucket", "crowded", "alone", "low", "anchor")]
            counts = [w["high"] - w["low"] + 1 for w in wanted]
            data = [text[w["low"] : w["high"] + LENGTH] for w in wanted]
            own = [pa.array([batch.column(c)[k].as_py()] * len(wanted), pa.int64()) for c in (0, 1)]
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], pa.array(counts, pa.int32()), pa.array(data, pa.binary())], names=names)


def _ranked(key: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Ranks of pairs of keys, equal for equal pairs."""
    order = np.lexsort((then, key))
    a, b = key[order], then[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])).astype(np.uint64)
    return rank


def repeated_starts(bucket: np.ndarray, anchor: np.ndarray, counts: np.ndarray, data: list[bytes]) -> list[np.ndarray]:
    """For each run, which of its suffixes equal another one to depth LENGTH.

    ``anchor`` is the anchor's place in the run's bytes, ``counts`` the number of
    suffixes. Whole buckets are given.
    """
    places, end, pieces = [], 0, []
    for a, d in zip(anchor.tolist(), data, strict=True):
        gap = -(end + a) % PERIOD
        places.append(end + gap)
        pieces += [bytes(gap), d]
        end += gap + len(d)
    text = np.frombuffer(b"".join(pieces) + bytes(2 * LENGTH), np.uint8)
    words = _words(text)
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    sample = np.flatnonzero(covered[np.arange(end + LENGTH) % PERIOD])
    slot = np.full(len(text), len(sample), np.int64)
    slot[sample] = np.arange(len(sample))
    # ranks of the samples by 16 bytes, then 32, ... 256; a sample's follower at a multiple of the period is one too
    rank = _ranked(words[sample], words[sample + 8])
    depth = PERIOD
    while depth < 256:
        ahead = np.minimum(sample + depth, len(text) - 1)
        rank = _ranked(rank, np.append(rank, np.uint64(0))[slot[ahead]])
        depth *= 2
    rank = np.append(rank, np.uint64(0))
    shift = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])

    run = np.repeat(np.arange(len(data)), counts)
    within = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.asarray(places)[run] + within
    follower = start + shift[start % PERIOD]
    # the bucket and where its anchor stands decide first, then the first 16 bytes
    keys = [np.asarray(anchor)[run] - within, bucket[run], words[start], words[start + 8]]
    order = np.lexsort(keys[::-1])

    def differs(values: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), bool)
        out[:1] = True
        for v in values:
            s = v[order]
            out[1:] |= s[1:] != s[:-1]
        return out

    fresh = differs(keys, order)
    group = np.cumsum(fresh)
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    order, group = order[tied], group[tied]
    at, after = start[order], follower[order]
    ties = [group, rank[slot[after]], rank[slot[after + 128]], words[at + 384], words[at + 392]]
    second = np.lexsort(ties[::-1])
    fresh = differs(ties, second)
    group = np.cumsum(fresh)
    again = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    found = np.zeros(len(run), bool)
    found[order[second[again]]] = True
    return np.split(found, np.cumsum(counts)[:-1])


def _spans(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by bucket; a block is made of whole buckets."""

    def work(table: pa.Table) -> pa.RecordBatch:
        low = table["low"].to_numpy()
        flags = repeated_starts(table["bucket"].to_numpy(), table["anchor"].to_numpy() - low, table["n"].to_numpy(), table["data"].to_pylist())
        rows, first, last = [], [], []
        for k, (alone, own) in enumerate(zip(table["alone"].to_pylist(), flags, strict=True)):
            if alone and own.any():
                a, b = _spans(own)
                rows += [k] * len(a)
                first += [x + int(low[k]) for x in a]
                last += [x + int(low[k]) for x in b]
        take = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([table["d"].combine_chunks().take(take), table["t"].combine_chunks().take(take), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["d", "t", "low", "high"])

    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held["data"].nbytes < BLOCK:
            continue
        bucket = held["bucket"].to_numpy()
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        if not len(cuts):
            continue
        sizes = np.cumsum([len(x) for x in held["data"].to_pylist()])
        done = 0
        for cut, following in zip(cuts.tolist(), [*cuts.tolist()[1:], None], strict=True):
            if following is None or sizes[following - 1] - (sizes[done - 1] if done else 0) > BLOCK:
                yield work(held.slice(done, cut - done).combine_chunks())
                done = cut
        held = held.slice(done)
    if held is not None and held.num_rows:
        yield work(held.combine_chunks())


def _chunks(size: int):
    """Cuts the runs of crowded buckets into chunks of ``size`` suffixes, at
    fixed places from the anchor. A chunk's bucket is its old one, its place and
    the bytes that all of its suffixes share, which any run with one of them has;
    its whole is the bytes of the suffixes that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, buckets, wholes, lows, counts, pieces = [], [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("bucket", "low", "anchor", "n", "data"))
            for k, (bucket, low, anchor, n, data) in enumerate(zip(*columns, strict=True)):
                at = low
                while at < low + n:
                    place = (at - anchor) // size
                    first, end = anchor + place * size, min(anchor + (place + 1) * size, low + n)
                    core = data[first + size - 1 - low : first + LENGTH - low]
                    piece = data[at - low : end - 1 + LENGTH - low]
                    rows.append(k)
                    buckets.append(xxhash.xxh3_64_intdigest(core, (bucket ^ place * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
                    wholes.append(xxhash.xxh3_64_intdigest(piece, at - first))
                    lows.append(at)
                    counts.append(end - at)
                    pieces.append(piece)
                    at = end
            take = pa.array(rows, pa.int64())
            own = [batch.column(c).take(take) for c in ("d", "t", "alone", "anchor")]
            hashes = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (buckets, wholes)]
            yield pa.RecordBatch.from_arrays([*own, *hashes, pa.array(lows, pa.int32()), pa.array(counts, pa.int32()), pa.array(pieces, pa.binary())], names=["d", "t", "alone", "anchor", "bucket", "whole", "low", "n", "data"])

    return run


def _crowded_spans(pieces: DataFrame) -> DataFrame:
    """The repeated suffixes of crowded buckets: chunk by chunk, ever smaller.

    Chunks equal as a whole repeat; those that share nothing with others don't;
    one of each kind that does is cut further. A run is cut where what it
    shares ends, so the rows follow the number of runs.
    """
    spans: DataFrame | None = None
    for size in CHUNKS:
        cut = settle(pieces.mapInArrow(_chunks(size), "d long, t long, alone boolean, anchor int, bucket long, whole long, low int, n int, data binary"))
        kinds = settle(cut.groupBy("bucket", "whole").agg(F.count("*").alias("times"), F.min(F.struct("d", "t", "low", "n", "anchor", "alone")).alias("one")))
        twice = settle(kinds.filter("times > 1").select("bucket", "whole"))
        found = cut.filter("alone").drop("data").join(twice, ["bucket", "whole"]).select("d", "t", "low", (F.col("low") + F.col("n") - 1).alias("high"))
        spans = found if spans is None else spans.unionByName(found)
        if size == 1:
            break
        mixed = settle(kinds.groupBy("bucket").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("bucket"))
        wanted = settle(kinds.join(mixed, "bucket").select("bucket", "whole", "one.*", (F.col("times") == 1).alias("single")))
        same = ["bucket", "whole", "d", "t", "low", "n", "anchor"]
        # a repeated row may offer its chunk twice: it isn't alone then, so it is only compared with
        pieces = wanted.join(cut.select(*same, "data"), same).select("bucket", "d", "t", (F.col("alone") & F.col("single")).alias("alone"), "low", "anchor", "n", "data")
    return spans


def _marked(docs: DataFrame) -> DataFrame:
    """d and t tell rows apart that aren't the same id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "t": F.xxhash64(text)})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, t, low, high): the suffixes at low to high, of the document d and t,
    equal others to depth LENGTH."""
    marked = _marked(docs.select("doc_id", "text")).select("d", "t", "text")
    place = "d long, t long, bucket long, whole long, low int, high int, anchor int"
    runs = settle(marked.mapInArrow(_runs, place))
    shared = settle(runs.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    runs = settle(runs.join(shared, "bucket"))
    kinds = settle(runs.groupBy("bucket", "whole").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "low", "high", "anchor")).alias("one")))
    # a passage that a large part of the corpus has is one key: its runs are told apart first, where they lie
    hot = settle(kinds.filter(F.col("n") > HOT).select(F.col("bucket").alias("hot_bucket"), F.col("whole").alias("hot_whole")))
    told = settle(runs.join(hot, (F.col("bucket") == F.col("hot_bucket")) & (F.col("whole") == F.col("hot_whole")), "left").withColumn("hot", F.col("hot_bucket").isNotNull()).drop("hot_bucket", "hot_whole"))
    twice = kinds.filter(F.col("n").between(2, HOT)).select("bucket", "whole")
    full = told.filter("hot").select("d", "t", "low", "high").unionByName(told.filter("not hot").join(twice, ["bucket", "whole"]).select("d", "t", "low", "high"))
    mixed = settle(kinds.groupBy("bucket").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    wanted = kinds.join(mixed, "bucket").select("one.*", "bucket", (F.col("kinds") > LARGEST).alias("crowded"), (F.col("n") == 1).alias("alone"))
    by_text = settle(wanted.groupBy("d", "t").agg(F.collect_list(F.struct("bucket", "crowded", "alone", "low", "high", "anchor")).alias("wanted")))
    texts = marked.select(F.col("d").alias("own_d"), F.col("t").alias("own_t"), "text")
    met = by_text.join(texts, (F.col("d") == F.col("own_d")) & (F.col("t") == F.col("own_t"))).select("d", "t", "text", "wanted")
    pieces = settle(met.mapInArrow(_with_bytes, "d long, t long, bucket long, crowded boolean, alone boolean, low int, anchor int, n int, data binary"))
    span = "d long, t long, low int, high int"
    few = pieces.filter("not crowded").select("bucket", "d", "t", "alone", "low", "anchor", "n", "data")
    sorted_few = few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_blocks, span)
    many = _crowded_spans(pieces.filter("crowded").select("bucket", "d", "t", "alone", "low", "anchor", "n", "data"))
    return full.unionByName(sorted_few).unionByName(many)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes spans of suffixes from each text."""
    for batch in batches:
        sizes, gone, runs, kept = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            merged: list[list[int]] = []
            for s in sorted((s["low"], s["high"] + LENGTH) for s in spans.as_py() or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *[x for m in merged for x in m], len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            sizes.append(len(data))
            gone.append(len(data) - len(rest))
            runs.append(len(merged))
            kept.append(rest)
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (sizes, gone, runs)], pa.array(digests), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): each document
    without the bytes that repeated strings cover; kept is what remains."""
    spans = settle(repeated_spans(docs).groupBy("d", "t").agg(F.collect_set(F.struct("low", "high")).alias("spans")))
    spans = spans.select(F.col("d").alias("at_d"), F.col("t").alias("at_t"), "spans")
    joined = _marked(docs.select("doc_id", "text")).join(spans, (F.col("d") == F.col("at_d")) & (F.col("t") == F.col("at_t")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
