"""Captures of a stream share a call of Python, and keep what they keep each for itself."""

import random
from datetime import datetime

import pandas as pd
import pyarrow.compute as pc
from test_stream import SCHEMA

from shapewright.functions.convert import Field
from shapewright.operators.lines import Region
from shapewright.plans.choice import Head, choices
from shapewright.plans.identify import Signature
from shapewright.plans.shape import Shape
from shapewright.streaming.buckets import _handled, by_bucket
from shapewright.streaming.stream import stream_identified, stream_parts
from shapewright.streaming.units import chosen, handled


class Kept:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None


def counting():
    def counted(kept, lines, last):
        size = (kept or 0) + len(lines)
        return ([(size, lines[0][1])] if last else []), size

    return counted


def test_a_call_takes_many_captures_and_leaves_those_without_new_lines():
    state, run = Kept(), _handled(counting(), ["n", "first"])
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["of", "num", "line", "last"])])
    first = pd.concat(run((7,), frame([(str(k), n, f"{k}-{n}", n == 2 and k % 2 == 0) for n in (2, 1) for k in range(100)]), state))
    assert sorted(first["of"]) == sorted(str(k) for k in range(0, 100, 2)) and set(first["n"]) == {2} and first["first"].str.endswith("-1").all()
    assert len(state.get[0]) == 50
    before = dict(zip(*state.get, strict=True))
    second = pd.concat(run((7,), frame([("1", 3, "x", True), (None, 1, "y", True)]), state))
    assert [(of, n) for of, n in zip(second["of"], second["n"], strict=True)] == [("1", 3), (None, 1)]
    assert dict(zip(*state.get, strict=True)) == {k: v for k, v in before.items() if k != "1"}
    pd.concat(run((7,), frame([(str(k), 9, "z", True) for k in range(3, 100, 2)]), state))
    assert not state.exists


def run_stream(spark, tmp_path, batches, schema, build):
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = build(source)
    q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return made, spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect()


def test_ids_of_any_type_come_back(spark, tmp_path):
    ids = [(None, "a"), ("b", "x, y"), ("b, x", "y")]
    rows = [((i, datetime(2024, 11, 3, 1, 30, 0, 7)), n, f"{i}{n}", n == 3) for i in ids for n in (1, 2, 3)]
    _, got = run_stream(spark, tmp_path, [rows[0:2] + rows[3:5], rows[6:7], rows[2:3] + rows[5:6] + rows[7:]], "capture_id struct<i:struct<a:string,b:string>,t:timestamp>, num long, line string, last boolean", lambda s: by_bucket(s, counting(), "n long, first string", 2))
    assert sorted(((r.capture_id.i.a or "", r.capture_id.i.b), r.capture_id.t, r.n) for r in got) == sorted((((a or ""), b), datetime(2024, 11, 3, 1, 30, 0, 7), 3) for a, b in ids)


def test_large_ids_beside_null(spark, tmp_path):
    rows = [(i, n, f"{n}", n == 2) for n in (1, 2) for i in (None, (1 << 53) + 1, 1 << 53)]
    _, got = run_stream(spark, tmp_path, [rows[:3], rows[3:]], SCHEMA.replace("capture_id int", "capture_id long"), lambda s: by_bucket(s, counting(), "n long, first string", 1))
    assert {(r.capture_id, r.n) for r in got} == {(None, 2), ((1 << 53) + 1, 2), (1 << 53, 2)}


def grouping(made):
    return made._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInPandasWithState", 1)[1][:200]


def test_parts_of_many_captures_are_not_grouped_one_by_one(spark):
    lines = spark.readStream.format("rate").load().selectExpr("cast(value as int) as capture_id", "value as num", "cast(value as string) as line", "true as last")
    shape = Shape("composite", parts={"all": Shape("regex", Region(), [r"^(?P<n>\d+)$"], fields={"n": Field("int")})})
    assert "bucket" in grouping(stream_parts(lines, shape))


def test_identified_captures_are_not_grouped_one_by_one(spark):
    lines = spark.readStream.format("rate").load().selectExpr("cast(value as int) as capture_id", "value as num", "cast(value as string) as line", "true as last")
    assert "bucket" in grouping(stream_identified(lines, [(Signature("n", "plain", all=(r"^\d",)), Shape("regex", patterns=[r"^(?P<n>\d+)$"]))], "report"))


KNOWN = [
    (Signature("pairs", "plain", all=(r"^\w+=",), none=(r"^\* ",), window=3), Shape("kv_list")), (Signature("pairs", "long", priority=5, all=(r"^\w+=", r"^end=\d+$"), window=3), Shape("kv_list")),
    (Signature("list", "plain", all=(r"^\* ",)), Shape("regex", patterns=[r"^\* (?P<item>.+)$"])), (Signature("pairs", "exact", priority=9, all=(r"\Aa=1\nb=2\z",), any=("a", "zz"), window=3), Shape("kv_list")),
    (Signature("tree", "plain", all=("^root$",), any=("^ leaf", "^ twig")), Shape("tree", indent=" ")), (Signature("late", "any", source=1, any=("^stray", "^--- "), window=4), Shape("regex", patterns=["(?P<x>.*)"])),
]
LINES = ["a=1", "b=2", "end=2", "* x", "", "stray", "--- q", "root", " leaf", " twig", "é=ü"]


def drawn(seed):
    rng = random.Random(seed)
    return [[rng.choice(LINES) for _ in range(rng.randrange(0, 7))] for _ in range(600)]


def test_choices_of_many_are_those_of_each():
    signatures = [s for s, _ in KNOWN]
    texts = drawn(1)

    def head(lines):
        made = Head(signatures)
        for x in lines:
            made.add(x)
        return made

    ended = [k % 3 == 0 for k in range(len(texts))]
    got = choices([head(t) for t in texts], ended)
    assert got == [head(t).choice(e) for t, e in zip(texts, ended, strict=True)]
    assert len({g for g in got if g and g[0] is not None}) == len(KNOWN) and None in got and (None, "no definition matches") in got
    assert choices([], []) == []


def test_a_buckets_captures_are_read_as_each_alone():
    columns, texts = ["parser", "part", "nth", "refusal", "nums", "texts"], drawn(2)
    rng = random.Random(3)
    cuts = [sorted(rng.randrange(len(t) + 1) for _ in range(2)) for t in texts]

    def read(which, most):
        state, run, out = Kept(), _handled(chosen(KNOWN, most), columns, together=True), []
        for batch in range(3):
            rows = []
            for k in which:
                at = [0, *cuts[k], len(texts[k])]
                rows += [(str(k), n + 1, texts[k][n], False) for n in range(at[batch], at[batch + 1])]
                rows += [(str(k), len(texts[k]) + 1, None, True)] if batch == 2 else []
            if rows:
                out += [r for frame in run((1,), iter([pd.DataFrame(rows, columns=["of", "num", "line", "last"])]), state) for r in frame.itertuples(index=False)]
        assert not state.exists
        return sorted(map(repr, out))

    for most in (1 << 20, 9):
        together = read(range(len(texts)), most)
        assert together == sorted(x for k in range(len(texts)) for x in read([k], most))
        assert any("exceeds 9 bytes" in x for x in together) == (most == 9)


def test_patterns_are_not_matched_capture_by_capture(monkeypatch):
    calls, real = [], pc.match_substring_regex
    monkeypatch.setattr(pc, "match_substring_regex", lambda texts, pattern: calls.append(len(texts)) or real(texts, pattern))
    rows = [(str(k), n, line, n == 3) for k in range(1000) for n, line in ((1, ["a=1", "* x", "?"][k % 3]), (2, ["b=2", "* y", "?"][k % 3]), (3, None))]
    run = _handled(chosen(KNOWN, 1 << 20), ["parser", "part", "nth", "refusal", "nums", "texts"], together=True)
    got = pd.concat(run((1,), iter([pd.DataFrame(rows, columns=["of", "num", "line", "last"])]), Kept()))
    assert len(got) == 334 * 2 + 333 * 2 + 333
    assert len(calls) < 30


PARTS = Shape("composite", parts={
    "head": Shape("regex", Region(limit=1), [r"^customer (?P<key>\d+)$"], fields={"key": Field("int")}), "orders": Shape("regex", Region(skip=1, until="^-- total$", ignore=("^#",)), [r"^- (?P<order>\d+)$"], fields={"order": Field("int")}),
    "total": Shape("kv_map", Region(after="^-- total$")),
})
FOLDED = Shape("regex", Region(fold="^ ", after="^begin", until="^end"), ["(?P<x>.*)"])


def test_parts_of_many_captures_are_those_of_each(monkeypatch):
    calls, real, columns = [], pc.match_substring_regex, ["part", "nth", "refusal", "nums", "texts"]
    monkeypatch.setattr(pc, "match_substring_regex", lambda texts, pattern: calls.append(len(texts)) or real(texts, pattern))
    rng = random.Random(4)
    parts = [["customer 1", *rng.choices(["- 7", "- 8", "# x", "", "-- total"], [5, 5, 1, 1, 1], k=rng.randrange(6)), "-- total", rng.choice(["k=v", "", "-- total x"])] for _ in range(300)]
    folded = [["begin", *rng.choices(["a", " b", "é", "", "end"], k=rng.randrange(1, 7)), "end"] for _ in range(300)]

    def read(shape, texts, which):
        state, run, out = Kept(), _handled(handled(shape, 1 << 20), columns, together=True), []
        for batch in range(2):
            rows = [(str(k), n, line, n == len(texts[k]) - 1) for k in which for n, line in enumerate(texts[k]) if (n < 3) == (batch == 0)]
            if rows:
                out += [r for frame in run((1,), iter([pd.DataFrame(rows, columns=["of", "num", "line", "last"])]), state) for r in frame.itertuples(index=False)]
        return sorted(map(repr, out))

    for shape, texts in ((PARTS, parts), (FOLDED, folded)):
        calls.clear()
        together = read(shape, texts, range(300))
        assert shape is FOLDED or len(calls) < 20
        assert together == sorted(x for k in range(300) for x in read(shape, texts, [k]))
        assert any("refusal=None" in x for x in together) and any("refusal=None" not in x for x in together)
