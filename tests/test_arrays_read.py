"""Lines of arrays read at once give what lines read one by one do."""

import pytest
from pyspark.sql import functions as F

from shapewright.functions.convert import Field
from shapewright.operators.lines import Region
from shapewright.plans.shape import Shape

ITEM = r"^\s*item (?P<key>\S*) of (?P<what>.*)$"
GROUPS = [
    ["item 1 of a", "item -22 of ", "  item +3 of b c"], ["item 999999999999999999 of a"], ["item 9223372036854775807 of a", "item 1 of b"], ["item 9223372036854775808 of a", "item 2 of b"],
    ["item 1 of a", "item x of b", "item y of c"], ["item 1 of a", "nothing"], ["item  of a"], ["item 1  of a", "item 2 of b"], ["item 1.5 of a"], ["item 1 of a﷐"], [None, "item 1 of a"], [], None,
]


@pytest.mark.parametrize("rules", [{}, {"key": Field("int")}, {"key": Field("int", required=True)}, {"key": Field("int"), "what": Field("string")}])
def test_lines_read_at_once_equal_those_read_one_by_one(spark, rules):
    reader = Shape("regex", patterns=[ITEM], fields=rules).line_reader()
    df = spark.createDataFrame([(k, g) for k, g in enumerate(GROUPS)], "k int, texts array<string>")
    read, value, refusal = reader.read_each(df, "read x", F.col("texts"))
    got = {r.k: (r.v, r.w) for r in read.select("k", value.alias("v"), refusal.alias("w")).collect()}
    one = {r.k: r.v for r in df.select("k", reader.values(F.col("texts")).alias("v")).collect()}
    for k, rows in one.items():
        whys = [r.refusal for r in rows or [] if r.refusal is not None]
        assert got[k][1] == (whys[0] if whys else None)
        keys = [tuple(r[n] for n in reader.keys) for r in rows] if rows is not None else None
        assert (got[k][0] if keys is None else [tuple(r) for r in got[k][0]]) == keys


def test_records_are_cut_once_and_their_integers_cast_as_arrays(spark):
    shape = Shape("records", start="^order ", parts={"head": Shape("regex", Region(limit=1), [r"^order (?P<order>\d+)$"], fields={"order": Field("int")}), "items": Shape("regex", Region(skip=1), [ITEM], fields={"key": Field("int")})})
    made = shape.documents(spark.createDataFrame([(1, "order 5\nitem 1 of a\nitem 2 of b\norder 6\n"), (2, "")], "capture_id int, text string"))
    assert [(r.capture_id, r.record, r.head[0].order, [x.key for x in r["items"]]) for r in made.orderBy("record").collect() if r.head] == [(1, 1, 5, [1, 2]), (1, 2, 6, [])]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\Aorder ") == 3  # where records begin, and the head's pattern: at once, and by line
    assert "as array<bigint>" in plan
