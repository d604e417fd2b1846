"""Pivot links and whitening against plain numpy; periodic runs against a scan of all periods."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from shapewright.llm import periodic_runs, pivot_links, queries, whitening
from shapewright.llm.common import reach_workers, table

VECTORS = "vec_id long, embedding array<double>, label int"


def told_plainly(rows, least=0.93):
    """(links, smallest id reachable) of each row, over all pairs."""
    root, links, spaces = list(range(len(rows))), [0] * len(rows), collections.defaultdict(list)
    for k, (_, e, label) in enumerate(rows):
        if e and label is not None and all(c is not None and np.isfinite(c) for c in e) and any(e):
            spaces[label, len(e)].append(k)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for at in spaces.values():
        v = np.array([rows[k][1] for k in at])
        v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of great entries run over
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        close = v @ v.T >= least
        for a, b in zip(*np.nonzero(close), strict=True):
            if a != b:
                links[at[a]] += 1
                x, y = find(at[a]), find(at[b])
                root[max(x, y)] = min(x, y)
    ids = collections.defaultdict(list)
    for k, r in enumerate(rows):
        ids[find(k)].append(r[0])
    return sorted((str(r[0]), links[k], str(min((i for i in ids[find(k)] if i is not None), default=None))) for k, r in enumerate(rows))


def clouds(seed, each, spreads):
    rng = np.random.default_rng(seed)
    rows = []
    for k, spread in enumerate(spreads):
        center = rng.normal(size=64)
        rows += [(len(rows) + j, (center + spread * rng.normal(size=64)).tolist(), k % 3) for j in range(each)]
    return rows


@pytest.mark.parametrize("crowd", [pivot_links.CROWD, 16])
def test_links_around_the_bound(spark, crowd):
    reach_workers(spark)
    rows = clouds(0, 40, np.linspace(0.01, 0.4, 24)) + clouds(1, 1, np.ones(200))
    rows = [(k, e, label) for k, (_, e, label) in enumerate(rows)]
    got = pivot_links.near_vectors(spark.createDataFrame(rows, VECTORS), crowd=crowd).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == told_plainly(rows)


def test_links_of_odd_rows(spark):
    reach_workers(spark)
    one = [0.5] * 64
    rows = [(1, one, 1), (2, one, 1), (2, [c * 7 for c in one], 1), (3, one, None), (4, None, 1), (5, [0.0] * 64, 1), (6, [float("nan"), *one[1:]], 1), (7, [None, *one[1:]], 1), (8, [], 1), (9, [1.0], 1), (10, [2e-300], 1), (None, one, 1), (None, [-c for c in one], 1), (11, [1e300] * 64, 1), (12, [-1e300] * 64, 2), (13, one, 2)]
    given = spark.createDataFrame(rows, VECTORS).withColumn("n", F.lit(1)).withColumn("ball", F.lit("clash"))
    got = pivot_links.near_vectors(given).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == told_plainly(rows)
    assert sum(r.kept for r in got) == 10
    assert pivot_links.near_vectors(given.limit(0)).collect() == []


def test_near_copies_cost_comparisons_in_proportion(spark):
    """All in one ball of one list: each is compared with its leader, none with each other."""
    reach_workers(spark)
    rng = np.random.default_rng(3)
    v = rng.normal(size=64) + 0.02 * rng.normal(size=(30000, 64))
    rows = spark.createDataFrame([(k, e, 1) for k, e in enumerate(v.tolist())], VECTORS)
    found = pivot_links.near_vectors(rows).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in found] == [(29999, 0, 30000)]


def test_recall_on_drawn_pairs_at_the_bound(spark):
    """Pairs just within the bound: the index alone can miss them."""
    reach_workers(spark)
    rng = np.random.default_rng(5)
    a, z = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    rows = [(2 * k + j, e.tolist(), 1) for k in range(2000) for j, e in enumerate((a[k], b[k]))]
    got = pivot_links.near_vectors(spark.createDataFrame(rows, VECTORS)).agg(F.sum("n_links").alias("s")).first().s
    assert 0.98 * 4000 < got <= 4000


def test_links_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SMALL, "embeddings").collect()]
    got = queries.op11_pivot_links(spark, SMALL).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == told_plainly(rows)


def test_whitening_of_the_table(spark):
    rows = {r.vec_id: r.embedding for r in table(spark, SMALL, "embeddings").collect()}
    x = {k: np.floor(64 * np.array(e)).astype(np.int64) + 1000000 for k, e in rows.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    values, axes = np.linalg.eigh(v)
    got = queries.op13_whitening(spark, SMALL).collect()
    assert len(got) == 16 * len(rows)
    signs = {}
    for r in got:
        want = (x[r.vec_id] - s / n) @ axes[:, -r.component] / np.sqrt(values[-r.component])
        sign = signs.setdefault(r.component, np.sign(want * r.whitened))
        assert r.whitened == pytest.approx(sign * want, abs=1e-8)
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], s, strict=True)) and r.n == n
        assert r.explained == pytest.approx(values[-r.component] / np.trace(v)) and r.identity_error < 1e-9


def test_products_of_digits_are_exact():
    rng = np.random.default_rng(2)
    for bits in (3, 19, 21, 40, 61):
        z = rng.integers(-(1 << bits), 1 << bits, (5000, 3))
        want = z.astype(object).T @ z.astype(object)
        assert (whitening.exact_products(z) == want).all()
    z = rng.integers(-9, 9, (10, 2)).astype(object) * 10**25
    assert (whitening.exact_products(z) == z.T @ z).all()
    for value in (0, -1, 10**40, -(10**40), (1 << 60) - 1):
        assert whitening.joined(whitening.limbs_of(value)) == value


def test_whitening_of_odd_rows(spark):
    reach_workers(spark)
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (None, [0.5, -3.0], None), (5, [], 1), (6, [1.0], 1), (7, [1e300, 0.0], 1), (8, [3.0, 2.5], 1), (9, [float("-inf"), 1.0], 1)]
    given = spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit(1)).withColumn("n", F.lit("clash"))
    got = whitening.whitened(given).collect()
    assert collections.Counter(r.vec_id for r in got) == {1: 4, None: 2, 6: 1, 8: 2}
    assert {r.n for r in got if r.vec_id != 6} == {3} and {(r.whitened, r.explained) for r in got if r.vec_id == 6} == {(0.0, 0.0)}
    assert whitening.whitened(given.limit(0)).collect() == []


def runs_plainly(words):
    """Maximal runs by a scan for each period; the smallest period of each stretch stays."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def test_runs_equal_a_scan_of_all_periods():
    rng = random.Random(1)
    met = 0
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            kinds = rng.choice([1, 2, 3, 5, 50])
            words = [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(150))]
            for _ in range(rng.randrange(3)):
                words += ([b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(1, 30))] * rng.randrange(2, 12))[: rng.randrange(200)]
            texts.append(words)
        want = [runs_plainly(t) for t in texts]
        met += sum(map(len, want))
        assert periodic_runs.texts_runs(texts) == want
    assert met > 200


def test_digests_of_the_table(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    rows = table(spark, SMALL, "documents").collect()
    assert len(got) == len(rows)
    held = 0
    for r in rows:
        words = [w for w in (r.text or "").encode().split()]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 1500:
            continue
        runs, one = runs_plainly(words), got[r.doc_id]
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        held += bool(runs)
        assert (one.n_runs, one.start, one.length, one.period) == (len(runs), *best)
        assert one.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert one.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert one.collapsed_sha256 == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
    assert held > 5


def test_runs_of_odd_rows(spark, monkeypatch):
    reach_workers(spark)
    loop = " ".join(["a b c"] * 9)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, loop), (4, loop), (4, loop), (5, "x " * 30000), (6, "é 漢\x00 " * 12)]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("start", F.lit("clash"))
    got = {(str(r.doc_id), r.n_runs, r.start, r.length, r.period) for r in periodic_runs.with_digests(periodic_runs.periodic_runs(given)).collect()}
    assert got == {("1", 0, None, None, None), ("2", 0, None, None, None), ("3", 0, None, None, None), ("None", 1, 0, 27, 3), ("4", 1, 0, 27, 3), ("5", 1, 0, 30000, 1), ("6", 1, 0, 24, 2)}
    assert periodic_runs.periodic_runs(given.limit(0)).collect() == []
