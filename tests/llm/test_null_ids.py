from pyspark.sql import functions as F
from test_operators import DOCS

from shapewright.llm import simhash
from shapewright.llm.common import reach_workers


def test_null_ids_link_and_one_row_of_each_group_stays(spark, monkeypatch):
    reach_workers(spark)
    # near by four bits: a - b and b - c, not a - c; b has no id
    fps = {"a": 0, "b": 0b1111, "c": 0b11111111, "alone": 0x0F0F0F0F00000000, "copy": (1 << 63) - (1 << 30)}
    rows = [(1, "a", "en", "s", 1), (None, "b", "en", "s", 1), (9007199254740993, "c", "en", "s", 1), (None, "alone", "en", "s", 1), (7, "copy", "en", "s", 1), (7, "copy", "en", "s", 1), (7, "copy", "fr", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    given = F.create_map(*[F.lit(x) for pair in fps.items() for x in pair])
    monkeypatch.setattr(simhash, "fingerprints", lambda d, words=4: d.select("doc_id", given[F.col("text")].alias("fp")))
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, fps["a"]): 1, (None, fps["b"]): 1, (9007199254740993, fps["c"]): 1, (None, fps["alone"]): None, (7, fps["copy"]): 7}


def test_simhash_one_each_on_odd_rows(spark):
    reach_workers(spark)
    rows = [(None, "one of its own", "en", "a", 1), (3, "the same words here", "en", None, None), (3, "the same words here", "en", None, None), (3, "the same words here", "fr", None, None), (None, "the same words here", "en", "a", 1), (5, None, None, None, None)]
    got = simhash.one_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "one of its own"), (3, "the same words here"), (5, "")]
