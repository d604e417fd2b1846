"""Documents that are built, read and explained, by value."""

import json

import pytest
from pyspark.sql import functions as F

from shapewright.functions.convert import Field
from shapewright.operators.lines import Region
from shapewright.plans import build, identify
from shapewright.plans.build import UsageError, read_only
from shapewright.plans.definition import disabled
from shapewright.plans.identify import Signature
from shapewright.plans.shape import DefinitionError, Shape
from shapewright.sources import readers
from shapewright.streaming.stream import write_json_lines


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "capture_id int, text string")


def test_yaml_core_scalars_and_refusals(spark):
    pytest.importorskip("yaml")
    good = {
        "a: 1\nb: true\nc: ~\nd: 'x'": {"a": 1, "b": True, "c": None, "d": "x"}, "- 0x1F\n- -7\n- 1e3\n- .5\n- 'true'\n- yes\n- 2024-01-02": [31, -7, 1000.0, 0.5, "true", "yes", "2024-01-02"],
        "{k: [a, {b: }]}": {"k": ["a", {"b": None}]}, "": None, "12345678901234567890123": 12345678901234567890123, "t: |\n  one\n  two\n": {"t": "one\ntwo\n"},
    }
    bad = ["a: 1\na: 2", "a: .inf", "- .nan", "a: &x 1\nb: *x", "a: !!str 1", "a: 1\n---\nb: 2", "[1", "? [a]\n: 1", "a: 1e999", None]
    rows = {r.capture_id: r for r in readers.yaml_documents(texts(spark, *good, *bad)).collect()}
    assert [json.loads(rows[k].json) for k in range(len(good))] == list(good.values())
    assert all(rows[k].refusal is None for k in range(len(good)))
    assert all(rows[k].json is None and rows[k].refusal for k in range(len(good), len(good) + len(bad)))


def test_nested_rows_as_json(spark):
    rows = spark.createDataFrame([(1, ["a", None], {"z": None}, (None, True), None), (2, [], {}, None, "x")], "k int, l array<string>, m map<string,double>, s struct<t:string,u:boolean>, o string")
    one, two = [r.json for r in build.encoded(rows, ["o"]).collect()]
    assert one == '{"k":1,"l":["a",null],"m":{"z":null},"s":{"t":null,"u":true}}'
    assert two == '{"k":2,"l":[],"m":{},"s":null,"o":"x"}'
    shown = [r.json for r in build.encoded(rows.select("k", "l", "s"), indent="  ").collect()]
    want = [{"k": 1, "l": ["a", None], "s": {"t": None, "u": True}}, {"k": 2, "l": [], "s": None}]
    assert shown == [json.dumps(w, indent=2) for w in want]
    assert build.encoded(rows.select("k").withColumn("n", F.lit(None).cast("string")).drop("k"), ["n"], indent="  ").first().json == "{}"


def test_keys_are_checked_before_texts_are_read(spark):
    shape = Shape("regex", patterns=[r"^(?P<a>\d+) (?P<b>\w)$"], fields={"a": Field("int")})
    unread = texts(spark, "1 x\n").withColumn("text", F.raise_error(F.lit("read")).cast("string"))
    for wrong in ({"extract": ["c"]}, {"exclude": ["capture_id"]}, {"extract": ["a"], "exclude": ["b"]}):
        with pytest.raises(UsageError):
            read_only(shape, unread, **wrong)
    assert [tuple(r) for r in read_only(shape, texts(spark, "1 x\n"), extract=["b"]).select("b").collect()] == [("x",)]
    assert "a" in read_only(shape, texts(spark, "1 x\n")).columns
    parts = Shape("composite", parts={"one": Shape("regex", Region(limit=1), ["^(?P<a>.*)$"]), "two": Shape("regex", Region(skip=1), ["^(?P<b>.*)$"])})
    assert read_only(parts, texts(spark, "x\ny\n"), exclude=["one"]).columns == ["capture_id", "two"]


def test_members_from_files_and_lists(spark, tmp_path):
    (tmp_path / "note").write_bytes(b"a\r\n\xc3\xa9\n")
    (tmp_path / "value").write_bytes(b' {"b":[1.50]}\n')
    (tmp_path / "torn").write_bytes(b"{")
    (tmp_path / "bytes").write_bytes(b"\xff")
    made = build.built(("=", "note", build.file_text(spark, str(tmp_path / "note"))), (":=", "v", build.file_text(spark, str(tmp_path / "value"), as_json=True)))
    assert spark.range(1).select(made).first()[0] == '{"note":"a\\r\\né\\n","v":{"b":[1.50]}}'
    for name in ("torn", "bytes"):
        with pytest.raises(UsageError):
            build.file_text(spark, str(tmp_path / name), as_json=True)
    assert spark.range(1).select(build.array_built()).first()[0] == "[]"
    with pytest.raises(UsageError):
        build.array_built(("[]=", F.lit("x")))
    with pytest.raises(UsageError):
        build.pointer("/a" * 1001)


def test_a_manifest_disables_what_later_sources_hold(spark, tmp_path):
    (tmp_path / "manifest.json").write_text('{"disable": ["df", "ls/long"]}')
    off = disabled(spark, str(tmp_path), 0)
    known = identify.catalog(spark, [Signature("df", "a", 1), Signature("df", "b", 0), Signature("ls", "long", 1), Signature("ls", "short", 1)])
    assert sorted((r.parser, r.variant) for r in identify.without_disabled(known, off).collect()) == [("df", "b"), ("ls", "short")]
    (tmp_path / "manifest.json").write_text('{"disable": ["../x"]}')
    with pytest.raises(DefinitionError):
        disabled(spark, str(tmp_path))


def test_a_choice_tells_what_was_ruled_out(spark):
    known = [Signature("a", "x", all=("^one",), priority=2), Signature("a", "y", all=("^one",), priority=1), Signature("b", "z", all=("^one",), args_all=("-q",))]
    given = texts(spark, "one\n", "two\n").withColumn("args", F.array(F.lit("-v")))
    first, second = sorted(identify.explained(given, known).collect())
    assert first == (0, "a", "x", None, ["a/x", "a/y"], ["b/z: needs the argument -q"])
    assert second == (1, None, None, "no definition matches", [], [])


def test_aligned_keys_from_headings(spark):
    shape = Shape("aligned", derived=True, rename={"id": "key"}, fields={"key": Field("int")})
    good = "Name      ID   Last Seen\nab cd     7    x y\n宽 e      8\n"
    rows = shape.read(texts(spark, good, "A  A\n1  2\n", "A  ID\nx  y\n"), "report").collect()
    told = [(r.capture_id, r.cells and dict(r.cells), r.key, r.refusal is not None) for r in rows]
    assert told == [
        (0, {"name": "ab cd", "key": "7", "last_seen": "x y"}, 7, False), (0, {"name": "宽 e", "key": "8", "last_seen": ""}, 8, False),
        (1, None, None, True), (2, {"a": "x", "key": "y"}, None, True),
    ]


def test_a_stream_written_as_json_lines(spark, tmp_path):
    schema = "capture_id int, num long, line string"
    spark.createDataFrame([(1, 1, "7 a"), (1, 2, "8 b")], schema).coalesce(1).write.json(str(tmp_path / "in"))
    shape = Shape("table", columns=["n", "t"], fields={"n": Field("int")})
    from shapewright.streaming.stream import stream_rows

    rows = stream_rows(spark.readStream.schema(schema).json(str(tmp_path / "in")), shape).select("n", "t")
    assert write_json_lines(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"n":7,"t":"a"}', '{"n":8,"t":"b"}']
