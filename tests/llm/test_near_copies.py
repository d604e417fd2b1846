import random

import pytest
from test_operators import DOCS, LONG, _root

import corpus_pipeline
from conftest import SMALL
from shapewright.llm import near_copies
from shapewright.llm.common import reach_workers, table


def sets(texts):
    out = []
    for t in texts:
        w = t.encode().lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    return out


def roots(texts):
    """Each text's root by holding every two sets against each other."""
    own = sets(texts)
    parent = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] == own[j] or 10 * both >= 8 * (len(own[i]) + len(own[j]) - both):
                a, b = _root(parent, i), _root(parent, j)
                parent[max(a, b)] = min(a, b)
    return [_root(parent, k) for k in range(len(own))]


def written():
    """Copies with some words changed, and texts of one shingle over and over."""
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
        for changed in (0, 1, 2, 3, 4):
            copy = list(base)
            for at in rng.sample(range(120), changed):
                copy[at] = "other"
            texts.append(" ".join(copy))
    return texts + ["again " * 400 + " ".join(f"{k}{n}" for n in range(100)) for k in "abc"]


@pytest.mark.parametrize("largest", [400, near_copies.LARGEST])
def test_groups_equal_brute_force(spark, largest):
    reach_workers(spark)
    texts = written()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], DOCS)
    got = near_copies.groups(docs, largest).toPandas()
    first = got.groupby("component").doc_id.min()
    assert [first[c] for c in got.sort_values("doc_id").component] == roots(texts)


def test_stage_keeps_one_of_each_group(spark):
    texts = written()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], DOCS)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect())
    assert got == sorted(set(roots(texts)))


def test_recall_on_the_corpus(spark):
    rows = table(spark, SMALL, "documents").orderBy("doc_id").collect()
    got = near_copies.groups(table(spark, SMALL, "documents")).toPandas().sort_values("doc_id")
    first = got.groupby("component").doc_id.min()
    assert [first[c] for c in got.component] == [rows[k].doc_id for k in roots([r.text or "" for r in rows])]


def test_null_ids_and_repeated_rows_keep_one(spark):
    reach_workers(spark)
    rows = [(None, "one of its own", "en", "a", 1), (3, LONG, "en", None, None), (3, LONG, "en", None, None), (3, LONG, "fr", None, None), (None, LONG, "en", "a", 1), (None, "twice here", "en", "b", 1), (None, "twice here", "en", "b", 1), (5, None, None, None, None), (4, " ", None, None, None)]
    got = near_copies.one_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in got)) == [(0, "one of its own"), (0, "twice here"), (3, LONG), (4, " ")]
    assert near_copies.one_each(spark.createDataFrame([], DOCS)).collect() == []
