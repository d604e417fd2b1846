import pytest

from shapewright.functions.convert import Field
from shapewright.operators.csv_text import records
from shapewright.operators.lines import Region, regioned
from shapewright.operators.parse import record_blocks
from shapewright.plans.shape import DefinitionError, Shape
from shapewright.streaming.stream import stream_blocks, stream_csv, stream_folded, stream_rows, stream_shape, stream_trees

TEXTS = ["# a\n1\n2\n# b\n# c\n3\n", "# z\n  more\n9\n"]
SCHEMA = "capture_id int, num long, line string, last boolean"


def feed(spark, tmp_path, build):
    """Runs a streaming plan over the texts' lines, in several batches."""
    rows = [(k, n, t, False) for k, text in enumerate(TEXTS) for n, t in enumerate(text.split("\n")[:-1], 1)] + [(k, 99, None, True) for k in range(len(TEXTS))]
    for k, part in enumerate((rows[:3], rows[3:7], rows[7:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    made = build(source)
    q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.schema(made.schema).parquet(str(tmp_path / "out"))


def test_blocks_equal_those_of_the_whole_text(spark, tmp_path):
    got = feed(spark, tmp_path, lambda s: stream_blocks(s, "^# "))
    captures = spark.createDataFrame(list(enumerate(TEXTS)), "capture_id int, text string")
    want = record_blocks(regioned(captures, Region()), "^# ")
    assert sorted((r.capture_id, r.record, r.texts) for r in got.collect()) == sorted((r.capture_id, r.record, [x.text for x in r.lines]) for r in want.collect())


def test_folded_lines(spark, tmp_path):
    got = feed(spark, tmp_path, lambda s: stream_folded(s, r"^\s"))
    assert sorted((r.num, r.line) for r in got.filter("capture_id = 1").collect()) == [(1, "# z more"), (3, "9")]


def test_rows_of_single_lines(spark, tmp_path):
    shape = Shape("regex", patterns=[r"^\s*(?P<t>.*)$"], fields={"t": Field()})
    got = feed(spark, tmp_path, lambda s: stream_rows(s, shape))
    assert got.count() == 9


def test_trees_and_quoted_csv_are_held_until_they_end(spark, tmp_path):
    def run(texts, build, name):
        rows = [(k, n, t, False) for k, text in enumerate(texts) for n, t in enumerate(text.split("\n")[:-1], 1)] + [(k, 99, None, True) for k in range(len(texts))]
        for part in (rows[:2], rows[2:5], rows[5:]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / name / "in"))
        made = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / name / "in")))
        q = made.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.read.schema(made.schema).parquet(str(tmp_path / name / "out")).collect()

    nodes = run(["a\n  b\n  c\n\nd\n", "e\n  f\n"], stream_trees, "tree")
    assert sorted((r.capture_id, r.record, r.texts) for r in nodes) == [(0, 1, ["a", "  b", "  c"]), (0, 2, ["d"]), (1, 1, ["e", "  f"])]
    texts = ['x,y\n"a\n""b"",\n",c"d\n,\n', '1;2,3\n"p",q\n']
    got = run(texts, stream_csv, "csv")
    want = [(k, n, at, values) for k, t in enumerate(texts) for n, (at, values) in enumerate(records(t), 1)]
    assert sorted((r.capture_id, r.record, r.num, r.cells) for r in got) == want


BOX = "+---+---+\n| A | B |\n+---+---+\n| 1 | x |\n|   | y |\n+---+---+\n"
PARTS = {"head": Shape("regex", Region(limit=1), [r"^(?P<name>\w+):$"]), "rows": Shape("regex", Region(skip=1), [r"^- (?P<n>\d+)$"], fields={"n": Field("int")})}
STREAMED = {
    "regex": (Shape("regex", Region(ignore=("^#",)), [r"^(?P<n>\d+)$"], fields={"n": Field("int")}), "# a\n1\r\n\n2\n"),
    "table": (Shape("table", columns=["a", "b"], fields={"a": Field("int")}), "1 x\n2 y z\n"),
    "header": (Shape("table", derived=True), "A B\n1 x\nA B\n2 y\n"),
    "pairs": (Shape("kv_list"), "a=1\nb = 2\n"),
    "labels": (Shape("ltsv"), "a:1\tb:2\na:3\n"),
    "map": (Shape("kv_map"), "a=1\nb = 2\n"),
    "sections": (Shape("ini"), "x=1\n[s]\na=1\n[t]\nb=2\n[s]\nc=3\n"),
    "box": (Shape("box"), BOX),
    "aligned": (Shape("aligned", columns=["a", "b"]), "A    B\nx    y\n"),
    "whole": (Shape("regex_input", patterns=[r"^(?P<a>.*)\n(?P<b>.*)$"]), "p\nq\n"),
    "select": (Shape("regex", Region(after="^B$", until="^E$"), [r"^(?P<n>\d+)$"]), "B\n1\n2\nE\n"),
    "blanks": (Shape("regex", Region(skip_blank=False), [r"^(?P<n>.*)$"]), "\n1\n\n2\n\n"),
    "fold": (Shape("regex", Region(fold=r"^ "), [r"^(?P<t>.*)$"]), "one\n two\nthree\n"),
    "csv": (Shape("csv"), 'a,b\n"x\ny",2\n3\n'),
    "tree": (Shape("tree"), "a\n  b\nc\n"),
    "composite": (Shape("composite", parts=PARTS), "x:\n- 1\n- 2\n"),
    "records": (Shape("records", start=r":$", parts=PARTS), "x:\n- 1\ny:\n- 2\n- 3\n"),
}


@pytest.mark.parametrize("name", list(STREAMED))
def test_stream_equals_batch(spark, tmp_path, name):
    shape, text = STREAMED[name]
    rows = [(0, n, t, False) for n, t in enumerate(text.split("\n")[:-1], 1)] + [(0, 99, None, True)]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    made = stream_shape(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), shape)
    q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = (shape.documents if shape.parse in ("composite", "records") else shape.read)(spark.createDataFrame([(0, text)], "capture_id int, text string"))
    got = spark.read.schema(made.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.drop("num").collect())) == sorted(map(str, want.drop("num").collect())) and want.count()


def test_stream_of_lines_refuses_what_hangs_on_others(spark):
    lines = spark.createDataFrame([(0, 1, "a", True)], SCHEMA)
    with pytest.raises(DefinitionError):
        stream_rows(lines, Shape("regex", Region(after="^B$"), ["^(?P<a>.)$"]))
