"""Near-duplicate embeddings by an index of pivot permutations.

A vector is described by its ``NEAREST`` nearest pivots in order. Pivots are
about 4 sqrt(n) unit vectors, 64 to 16,384: vectors of the table that are far
apart from each other, drawn by hash from at most twice as many, and drawn
directions where those don't suffice. Two vectors of a label that link share most
of their pivots. Each is filed under the rarest of its own, so many that two that
share ``SHARED`` meet in a list; a task counts the pivots shared by those of its
list and tells what shares enough, once a pair, and its cosine settles it.

Copies: like vectors are one class with a count. Classes within half the linking
angle of a leader make a ball, all of which link with each other, and leaders
alone are indexed. Two balls link whole, or not at all, where their radii and the
angle between leaders say so; else each member is set against the other's leader
in the same way, and only members that this can't decide meet. So n near copies
cost some n comparisons for each leader, and not n squared, and their numbers of
links are exact.

Hot keys: a ball's key is cut by hash to ``CROWD`` classes at a time, and
the leaders found meet again until a key fits or leaders no longer get fewer. A list
of over ``CROWD`` is told apart by a second shared pivot; one that is crowded
still is cut by hash and every two cuts meet. No pair is dropped by this.

Recall: pairs are missed only where fewer than ``SHARED`` pivots agree. At a cosine
of 0.93, in 64 dimensions and drawn data, 0.998 of pairs agree so with 905 pivots,
0.94 with 16,384; closer pairs nearly all do. No pair below the bound is linked.

Rows: null or odd vectors, zero ones and those of a null label link with nothing
and are components of their own. Vectors of unlike lengths never link. Repeated
rows and repeated ids each count as a row and link; null ids count as rows, and a
component of null ids alone has a null id and keeps nothing. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import components
from .vectors import lists_of, matrices, sound, whole_groups

NEAREST = 12
SHARED = 4
CROWD = 8192
MOST_PIVOTS = 16384
#: Cosine under which two vectors of the table are both taken as pivots.
APART = 0.7
SEED = 11
#: Angles are told within this much; what is nearer to a bound is settled by the cosine itself.
SLACK = 1e-7
#: Rows of a list that are counted against the rest together.
ROWS = 512


SPACE = ["label", "length"]


def chosen_pivots(sample: list[list[float]], count: int) -> np.ndarray:
    """``count`` unit vectors: those of ``sample``, in order, that are apart from all
    before them, and drawn ones. Vectors are cut or filled with zeros to the commonest length."""
    lengths = [len(v) for v in sample]
    across = max(set(lengths), key=lambda d: (lengths.count(d), d), default=1)
    given = np.zeros((len(sample), across))
    for row, v in zip(given, sample, strict=True):
        row[: len(v)] = v[:across]
    given /= np.maximum(np.abs(given).max(axis=1, keepdims=True, initial=0), 1e-300)
    given /= np.maximum(np.linalg.norm(given, axis=1, keepdims=True), 1e-300)
    pivots = np.zeros((count, across))
    held = 0
    for at in range(0, len(given), ROWS):
        block = given[at : at + ROWS]
        block = block[(block @ pivots[:held].T < APART).all(axis=1)]
        near = block @ block.T >= APART
        taken = np.zeros(len(block), bool)
        for k in range(len(block)):
            taken[k] = not (near[k] & taken).any()
        block = block[taken][: count - held]
        pivots[held : held + len(block)] = block
        held += len(block)
    drawn = np.random.default_rng(SEED).normal(size=(count - held, across))
    pivots[held:] = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
    return pivots


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision at length 1; none is zero."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first."""
    across = min(vectors.shape[1], pivots.shape[1])
    out = np.empty((len(vectors), NEAREST), np.int32)
    for at in range(0, len(vectors), ROWS):
        close = vectors[at : at + ROWS, :across] @ pivots[:, :across].T
        some = np.sort(np.argpartition(-close, NEAREST - 1, axis=1)[:, :NEAREST], axis=1)
        order = np.argsort(-np.take_along_axis(close, some, 1), axis=1, kind="stable")
        out[at : at + ROWS] = np.take_along_axis(some, order, 1)
    return out


def _described(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in matrices(batch.column(2)):
                v = unit(found)
                near = nearest(v, pivots)
                took = batch.take(pa.array(rows))
                columns = [took.column(0), took.column(1), took.column(3), took.column(4), pa.array(np.full(len(rows), v.shape[1], np.int32)), lists_of(v), pa.array(near[:, 0]), lists_of(near)]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "label", "n", "least_id", "length", "vec", "near", "pivots"])

    return run


def _balls(half: float):
    """(cls, leader, angle): classes of a key under leaders whose angle and the class's own radius stay within ``half``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(frames, [*SPACE, "near", "cut"]):
            part = part.sort_values("cls")
            v, own, cls = np.stack(part["vec"].to_list()), part["radius"].to_numpy(), part["cls"].to_numpy()
            leader, angle = cls.copy(), np.zeros(len(cls))
            free = np.arange(len(cls))
            if len(cls) <= ROWS:  # leaders without any other near are the rule
                close = v @ v.T >= np.cos(half)
                free = free[close.sum(axis=1) > 1]
            while len(free):
                far = np.arccos(np.clip(v[free] @ v[free[0]], -1, 1))
                mine = far + own[free] <= half
                mine[0], far[0] = True, 0.0
                leader[free[mine]], angle[free[mine]] = cls[free[0]], far[mine]
                free = free[~mine]
            yield pd.DataFrame({"cls": cls, "leader": leader, "angle": angle})

    return run


def _cut(rows: DataFrame, keys: list[str], crowded: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``cut`` and ``cuts``: keys listed in ``crowded`` with a number of cuts are cut by hash of ``by``."""
    return rows.join(crowded, keys, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("cut", F.pmod(F.xxhash64(by), F.col("cuts")).cast("int"))


def _crowded(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    return rows.groupBy(*keys).count().filter(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("cuts"))


def balls_of(nodes: DataFrame, half: float, crowd: int = CROWD) -> DataFrame:
    """(cls, leader, reach): each class of ``nodes`` and a bound of its angle to its leader."""
    keys = [*SPACE, "near"]
    at = nodes.select(*keys, "cls", "vec", F.lit(0.0).alias("radius"))
    found, last = None, None
    while True:
        crowded = settle(_crowded(at, keys, crowd))
        cut = _cut(at, keys, crowded, "cls").select(*keys, "cut", "cls", "vec", "radius")
        got = settle(cut.repartition(*keys, "cut").sortWithinPartitions(*keys, "cut").mapInPandas(_balls(half), "cls long, leader long, angle double"))
        if found is None:
            found = got.withColumnRenamed("angle", "reach")
        else:
            above = got.select(F.col("cls").alias("leader"), F.col("leader").alias("above"), "angle")
            found = settle(found.join(above, "leader", "left").select("cls", F.coalesce("above", "leader").alias("leader"), (F.col("reach") + F.coalesce("angle", F.lit(0.0))).alias("reach")))
        if crowded.isEmpty():
            return found
        radii = found.groupBy(F.col("leader").alias("cls")).agg(F.max("reach").alias("radius"))
        at = settle(nodes.join(crowded.drop("cuts"), keys, "left_semi").select(*keys, "cls", "vec").join(radii, "cls"))
        left = at.count()
        if last is not None and 2 * left > last:
            return found
        last = left


def _ranked(rank: np.ndarray):
    """Pivots as their ranks by frequency, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ranks = np.sort(rank[np.stack(batch.column(3).to_numpy(zero_copy_only=False))], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists_of(ranks)], names=["ball", "label", "length", "ranks"])

    return run


def shared_pairs(ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of the rows that share ``SHARED`` or more numbers."""
    for a in range(0, len(ranks), ROWS):
        names = np.unique(ranks[a : a + ROWS])
        marks = []
        for b in range(a, len(ranks), ROWS):
            block = ranks[b : b + ROWS]
            at = np.minimum(np.searchsorted(names, block), len(names) - 1)
            there = names[at] == block
            mark = np.zeros((len(block), len(names)), np.float32)
            mark[np.nonzero(there)[0], at[there]] = 1
            marks = marks or [mark]
            i, j = np.nonzero(marks[0] @ mark.T >= SHARED)
            ordered = i + a < j + b
            yield i[ordered] + a, j[ordered] + b


def _retrieved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v): pairs of a list that share enough, told where their rarest shared pivots are the list's."""
    for part in whole_groups(frames, [*SPACE, "pivot", "second", "one", "two"]):
        if len(part) < 2:
            continue
        ranks, ball, cut = np.stack(part["ranks"].to_list()), part["ball"].to_numpy(), part["cut"].to_numpy()
        pivot, second, across = part["pivot"].iat[0], part["second"].iat[0], part["one"].iat[0] != part["two"].iat[0]
        for i, j in shared_pairs(ranks):
            if across:
                i, j = i[cut[i] != cut[j]], j[cut[i] != cut[j]]
            for at in range(0, len(i), 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                common = (ranks[a][:, :, None] == ranks[b][:, None, :]).any(axis=2)
                each, first = np.arange(len(a)), common.argmax(axis=1)
                own = ranks[a, first] == pivot
                if second >= 0:
                    common[each, first] = False
                    own &= ranks[a, common.argmax(axis=1)] == second
                yield pd.DataFrame({"u": np.minimum(ball[a[own]], ball[b[own]]), "v": np.maximum(ball[a[own]], ball[b[own]])})


def candidates(balls: DataFrame, count: int, crowd: int = CROWD) -> DataFrame:
    """(u, v): leaders of one label and length that share ``SHARED`` of their pivots, each pair once."""
    often = np.zeros(count, np.int64)
    for r in balls.select(F.explode("pivots").alias("pivot")).groupBy("pivot").count().toLocalIterator():  # one row a pivot
        often[r.pivot] = r["count"]
    rank = np.empty(count, np.int32)
    rank[np.lexsort((np.arange(count), often))] = np.arange(count, dtype=np.int32)
    label = balls.schema["label"].dataType.simpleString()
    ranked = settle(balls.select("ball", "label", "length", "pivots").mapInArrow(_ranked(rank), f"ball long, label {label}, length int, ranks array<int>"))
    posted = NEAREST - SHARED + 1  # two that share enough have their rarest shared one among so many of either
    filed = ranked.select("ball", *SPACE, "ranks", F.posexplode(F.slice("ranks", 1, posted)).alias("place", "pivot"))
    crowded = settle(_crowded(filed, [*SPACE, "pivot"], crowd))
    told_apart = F.when(F.col("cuts").isNull(), F.array(F.lit(-1))).otherwise(F.slice("ranks", F.col("place") + 2, posted - F.col("place")))
    filed = filed.join(crowded, [*SPACE, "pivot"], "left").select("ball", *SPACE, "ranks", "pivot", F.explode(told_apart).alias("second"))
    keys = [*SPACE, "pivot", "second"]
    still = settle(_crowded(filed.filter("second >= 0"), keys, crowd // 2))
    met = _cut(filed, keys, still, "ball").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    met = met.select(*keys, F.least("cut", "other").alias("one"), F.greatest("cut", "other").alias("two"), "cut", "ball", "ranks")
    keys += ["one", "two"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_retrieved, "u long, v long")


def _cosine(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


def _told(radius: Column, least: float) -> Column:
    """1: all within ``radius`` link, 0: none does, -1: that isn't known from the column ``cos``."""
    angle, widest = F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0))), acos(least)
    near = F.when(angle + radius <= widest - SLACK, 1).when(angle - radius > widest + SLACK, 0).otherwise(-1)
    return F.when(radius == 0, (F.col("cos") >= least).cast("int")).otherwise(near)


def _met(least: float):
    """(cls, links, lo, hi): rows that members of one ball link to among those of another."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(frames, ["lo", "hi", "cut_lo", "cut_hi"]):
            low = (part["ball"] == part["lo"]).to_numpy()
            if low.all() or not low.any():
                continue
            v, n, cls = np.stack(part["vec"].to_list()), part["n"].to_numpy(), part["cls"].to_numpy()
            links = np.zeros(len(cls), np.int64)
            at_low, at_high = np.flatnonzero(low), np.flatnonzero(~low)
            for at in range(0, len(at_low), ROWS):
                mine = at_low[at : at + ROWS]
                linked = v[mine] @ v[at_high].T >= least
                links[mine] = linked @ n[at_high]
                links[at_high] += n[mine] @ linked
            yield pd.DataFrame({"cls": cls, "links": links, "lo": part["lo"], "hi": part["hi"]})

    return run


def _unsure_links(unsure: DataFrame, balls: DataFrame, members: DataFrame, least: float, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(cls, links) and (u, v) of balls that neither link whole nor are apart: members
    are set against the other's leader, and those that this can't decide against each other."""
    both = unsure.select(F.col("u").alias("ball"), F.col("v").alias("other")).union(unsure.select(F.col("v"), F.col("u")))
    others = balls.select(F.col("ball").alias("other"), F.col("vec").alias("center"), "radius", "size")
    met = both.join(members, "ball").join(others, "other").withColumn("cos", _cosine("vec", "center"))
    met = settle(met.select("cls", "n", "ball", "other", "size", _told(F.col("radius"), least).alias("told")))
    whole = met.filter("told = 1")
    # a member that links with all of a ball does so with those that can't decide by themselves
    given = whole.groupBy(F.col("other").alias("ball"), F.col("ball").alias("other")).agg(F.sum("n").alias("links"))
    open_ = met.filter("told = -1")
    pair = [F.least("ball", "other").alias("lo"), F.greatest("ball", "other").alias("hi")]
    sides = settle(open_.groupBy("ball", "other").agg(F.ceil(F.count("*") / crowd).cast("int").alias("cuts")))
    far = sides.select(F.col("ball").alias("other"), F.col("other").alias("ball"), F.col("cuts").alias("far_cuts"))
    spread = open_.join(sides, ["ball", "other"]).join(far, ["ball", "other"]).withColumn("own", F.pmod(F.xxhash64("cls"), "cuts").cast("int"))
    spread = spread.withColumn("over", F.explode(F.sequence(F.lit(0), F.col("far_cuts") - 1)))
    low = F.col("ball") < F.col("other")
    spread = spread.select("cls", "n", "ball", *pair, F.when(low, F.col("own")).otherwise(F.col("over")).alias("cut_lo"), F.when(low, F.col("over")).otherwise(F.col("own")).alias("cut_hi"))
    keys = ["lo", "hi", "cut_lo", "cut_hi"]
    faced = spread.join(members.select("cls", "vec"), "cls").repartition(*keys).sortWithinPartitions(*keys)
    found = settle(faced.mapInPandas(_met(least), "cls long, links long, lo long, hi long").filter("links > 0"))
    counts = whole.select("cls", F.col("size").alias("links")).union(open_.join(given, ["ball", "other"]).select("cls", "links")).union(found.select("cls", "links"))
    return counts.groupBy("cls").agg(F.sum("links").alias("links")), whole.select(*pair).union(found.select("lo", "hi")).distinct().toDF("u", "v")


def near_vectors(embeddings: DataFrame, least: float = 0.93, crowd: int = CROWD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``embeddings`` (vec_id,
    embedding, label): other rows of its label that link with it, the smallest id that links lead to."""
    vector = F.col("embedding")
    rows = embeddings.select("vec_id", "label", "embedding")
    usable = sound(vector) & F.col("label").isNotNull() & F.coalesce(F.exists(vector, lambda c: c != 0), F.lit(False))
    classes = rows.filter(usable).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    classes = settle(classes.withColumn("cls", F.monotonically_increasing_id()))
    many = classes.count()
    count = min(max(ceil(4 * sqrt(many)), 64), MOST_PIVOTS)
    sample = classes.select("embedding", F.xxhash64("embedding").alias("drawn")).orderBy("drawn", "embedding").limit(2 * count).select("embedding")
    pivots = chosen_pivots([r.embedding for r in sample.collect()], count)  # at most 2 * MOST_PIVOTS
    label, id_kind = (rows.schema[c].dataType.simpleString() for c in ("label", "vec_id"))
    shape = f"cls long, label {label}, n long, least_id {id_kind}, length int, vec array<double>, near int, pivots array<int>"
    nodes = settle(classes.select("cls", "label", "embedding", "n", "least_id").mapInArrow(_described(pivots), shape))
    found = balls_of(nodes, acos(least) / 2 - SLACK, crowd)
    sizes = found.join(nodes.select("cls", "n", "least_id"), "cls").groupBy(F.col("leader").alias("cls"))
    sizes = sizes.agg(F.sum("n").alias("size"), F.max("reach").alias("radius"), F.min("least_id").alias("least_id"))
    balls = settle(nodes.drop("least_id", "n").join(sizes, "cls").withColumnRenamed("cls", "ball"))
    one = balls.select(F.col("ball").alias("u"), F.col("vec").alias("vec_u"), F.col("radius").alias("radius_u"), F.col("size").alias("size_u"))
    two = balls.select(F.col("ball").alias("v"), F.col("vec").alias("vec_v"), F.col("radius").alias("radius_v"), F.col("size").alias("size_v"))
    judged = candidates(balls, count, crowd).join(one, "u").join(two, "v").withColumn("cos", _cosine("vec_u", "vec_v"))
    judged = settle(judged.select("u", "v", "size_u", "size_v", _told(F.col("radius_u") + F.col("radius_v"), least).alias("told")).filter("told <> 0"))
    whole = judged.filter("told = 1")
    members = found.withColumnRenamed("leader", "ball").join(nodes.select("cls", "n", "vec"), "cls")
    some, linked = _unsure_links(judged.filter("told = -1"), balls, members, least, crowd)
    groups = components(whole.select("u", "v").union(linked)).select(F.col("node").alias("ball"), "component")
    rooted = settle(balls.select("ball", "size", "least_id").join(groups, "ball", "left").withColumn("component", F.coalesce("component", "ball")))
    ids = rooted.groupBy("component").agg(F.min("least_id").alias("component_id"))
    outer = whole.select(F.col("u").alias("ball"), F.col("size_v").alias("links")).union(whole.select("v", "size_u")).groupBy("ball").agg(F.sum("links").alias("outer"))
    named = rooted.join(ids, "component").join(outer, "ball", "left").select("ball", "component_id", (F.col("size") - 1 + F.coalesce("outer", F.lit(0))).alias("inner"))
    told = found.withColumnRenamed("leader", "ball").join(named, "ball").join(some, "cls", "left")
    told = told.select("cls", "component_id", (F.col("inner") + F.coalesce("links", F.lit(0))).alias("n_links"))
    told = settle(classes.select("cls", "label", "embedding").join(told, "cls").drop("cls"))
    linked_rows = rows.filter(usable).join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
