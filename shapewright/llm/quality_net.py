"""Quality scores from random-indexing word vectors and a two-layer network.

Each word falls into one of ``BUCKETS`` buckets, each of which has an index
vector: a few places of +1 and -1 by its hash. A bucket's word vector is the
sum of the index vectors of the words within two places of its occurrences,
over the whole corpus: tasks add up integers, so the sums are the same in any
order. A document is the mean and the spread of its words' unit vectors, with its
length and the share of words that differ. A
network with one hidden layer is fitted to at most ``SAMPLE`` labelled
documents (those of the smallest hash of the id) that aren't held out; a fifth
of them are kept back to fit the temperature by which its scores are divided.

What is broadcast is the table of word vectors, BUCKETS x PLACES numbers, and
the network's weights; neither grows with the data.

Texts: null counts as empty; an empty text is the zero vector and has the score
that this has. Labels without a document, id or quality are left out; of
several for a document, the smallest counts, and of several texts of an id that
of the smallest hash. Without labels of both kinds, every
score is the share of label 1, or 0.5 where there are none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
PLACES = 32
NONZERO = 4
FEATURES = 2 * PLACES + 2
WINDOW = 2
#: Labelled documents that the network is fitted to, at most.
SAMPLE = 8192
HIDDEN = 24
#: A Chinese, Japanese or Korean character (three bytes from E3 to ED), letters, digits, or a run of other characters.
WORD = re.compile(rb"[\xe3-\xed][\x80-\xbf]{2}|[A-Za-z\x80-\xe2\xee-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+")
REMEMBERED = 500_000
#: Bytes of a word that is remembered, at most, so that a worker's memory is bounded in bytes.
LONGEST = 64


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        got = zlib.crc32(word) % BUCKETS
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = got
        return got


_BUCKET_OF = Buckets()


def buckets_of(text: str) -> np.ndarray:
    words = WORD.findall(text.encode())
    return np.fromiter(map(_BUCKET_OF.__getitem__, words), np.int64, len(words))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (BUCKETS x NONZERO) of each bucket's index vector."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random((BUCKETS, PLACES)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1, 1], (BUCKETS, NONZERO))


def context_sums(docs: DataFrame) -> np.ndarray:
    """The word vectors of all documents' words (BUCKETS x PLACES integers)."""
    columns = [f"v{k}" for k in range(PLACES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums = np.zeros(BUCKETS * PLACES, np.int64)

        def add(texts: list[np.ndarray]) -> None:
            gap = np.full(WINDOW, -1)
            words = np.concatenate([x for t in texts for x in (t, gap)])
            for hop in range(1, WINDOW + 1):
                a, b = words[:-hop], words[hop:]
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                for k in range(NONZERO):
                    for one, other in ((a, b), (b, a)):
                        added = np.bincount(one * PLACES + places[other, k], signs[other, k], BUCKETS * PLACES)
                        np.add(sums, added.astype(np.int64), out=sums)

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(buckets_of(text.as_py() or ""))
                size += len(held[-1])
                if size > 1 << 18:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        table = sums.reshape(BUCKETS, PLACES)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(table[used, k]) for k in range(PLACES)]], names=["bucket", *columns])

    parts = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    found = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    table = np.zeros((BUCKETS, PLACES), np.int64)
    table[found["bucket"].to_numpy(np.int64)] = found[columns].to_numpy(np.int64)
    return table


def pooled(text: str, units: np.ndarray) -> np.ndarray:
    """A document's vector: mean and spread of its words' unit vectors, how many
    words it has and what share of them differ."""
    words = buckets_of(text)
    if not len(words):
        return np.zeros(FEATURES)
    counts = np.bincount(words, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    share = counts[used] / len(words)
    mean = share @ units[used]
    spread = np.sqrt(np.maximum(share @ units[used] ** 2 - mean**2, 0))
    return np.concatenate([mean, spread, [np.log1p(len(words)) / 8, len(used) / len(words)]])


@dataclass
class Network:
    """Two layers and a temperature; ``constant`` where there was nothing to fit."""

    layers: list[np.ndarray]
    centre: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fitted(x: np.ndarray, y: np.ndarray, apart: np.ndarray, rounds: int = 400) -> Network:
    """Fits the network to the rows not ``apart`` and the temperature to those."""
    if len(set(y.tolist())) < 2:
        return Network([], np.zeros(0), np.ones(0), constant=float(y.mean()) if len(y) else 0.5)
    fit = ~apart if len(set(y[~apart].tolist())) == 2 else np.ones(len(y), bool)
    rng = np.random.default_rng(11)
    net = Network([rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)], x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3)
    a, b = (x[fit] - net.centre) / net.scale, y[fit]
    first, second = ([np.zeros_like(w) for w in net.layers] for _ in range(2))
    for step in range(1, rounds + 1):
        w1, b1, w2, b2 = net.layers
        hidden = np.tanh(a @ w1 + b1)
        error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -40, 40))) - b) / len(b)
        back = np.outer(error, w2) * (1 - hidden**2)
        slopes = [a.T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, np.array([error.sum()])]
        for w, g, m, v in zip(net.layers, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if apart.any():
        z, t = net.logits(x[apart]), y[apart]
        tried = np.geomspace(0.25, 8, 61)
        losses = [np.mean(np.logaddexp(0, z / k) - t * z / k) for k in tried]
        net.temperature = float(tried[int(np.argmin(losses))])
    return net


def remainder(doc_id: Column, of: int = 3) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def learned(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """The units of the word vectors and the network fitted to the labels."""
    table = context_sums(docs).astype(float)
    units = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(remainder(F.col("doc_id")) != 1)
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [pooled(t.as_py() or "", units) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(vectors, pa.list_(pa.float64()))], names=["doc_id", "quality", "h", "x"])

    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    # of rows that repeat an id, the text of the smallest hash is learned from; only SAMPLE rows reach the driver
    rows = some.mapInArrow(run, "doc_id long, quality int, h long, x array<double>").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("x", "h").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist()).reshape(len(rows), FEATURES)
    apart = np.array([zlib.crc32(b"calibration %d" % i) % 5 == 0 for i in rows["doc_id"]], bool)
    return units, fitted(x, rows["quality"].to_numpy(float), apart)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted; clashing columns are replaced."""
    units, net = learned(docs, labels)
    docs = docs.drop("held_out", "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([pooled(t.as_py() or "", units) for t in batch.column("text")]).reshape(-1, FEATURES)
            yield batch.append_column("score", pa.array(net.scores(x)))

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    scored = docs.mapInArrow(run, schema)
    return scored.withColumns({"held_out": F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")})
