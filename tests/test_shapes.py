"""Tables with headings that come again, boxes under rules, trees, documents of all kinds of parts, CSV blocks."""

import json

import pytest

from shapewright.functions.convert import Field
from shapewright.operators import csv_text
from shapewright.operators.lines import Region
from shapewright.plans.definition import definition
from shapewright.plans.shape import Shape

KV = Shape("regex", patterns=[r"^(?P<name>[^:]+): (?P<value>.*)$", r"^(?P<text>.+)$"])


def captures(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "capture_id long, text string")


def nested(spark, shape, *texts):
    rows = shape.nested(captures(spark, *texts), "report").orderBy("capture_id").collect()
    return [json.loads(r.json) if r.refusal is None else r.refusal for r in rows]


def test_trees_as_nested_values(spark):
    shape = Shape("tree", node=KV)
    got = nested(spark, shape, "a: 1\n  b: 2\n    c: 3\n  d: 4\ne: 5\n", "a: 1\nb: 2\n", "", "x\n")
    assert json.dumps(got[0], separators=(",", ":")) == '[{"name":"a","value":"1","children":[{"name":"b","value":"2","children":[{"name":"c","value":"3","children":[]}]},{"name":"d","value":"4","children":[]}]},{"name":"e","value":"5","children":[]}]'
    assert got[1] == [{"name": "a", "value": "1", "children": []}, {"name": "b", "value": "2", "children": []}]
    assert got[2] == [] and got[3] == [{"text": "x", "children": []}]
    value = shape.nested(captures(spark, "a: 1\n  b: 2\n")).selectExpr("variant_get(tree, '$[0].children[0].value', 'string') v").first().v
    assert value == "2"


@pytest.mark.parametrize("text", ["a: 1\n    b: 2\n", "    a: 1\n", "a: 1\n  b: 2\n      c: 3\n"])
def test_a_tree_that_skips_a_level_is_refused(spark, text):
    assert nested(spark, Shape("tree", node=KV), text) == ["a skipped level"]
    assert "a skipped level" in [r.refusal for r in Shape("tree").read(captures(spark, text), "report").collect()]


def test_part_of_an_indent_and_depth(spark):
    shape = Shape("tree", node=KV)
    assert nested(spark, shape, "a: 1\n   b: 2\n") == ["part of an indent"]
    deep = "".join("  " * k + "a: 1\n" for k in range(33))
    assert isinstance(nested(spark, shape, deep)[0], list)
    assert nested(spark, shape, deep + "  " * 33 + "a: 1\n") == ["over 32 levels"]


def test_roots(spark):
    shape = Shape("tree", root=r"^[0-9a-f]{2}:[0-9a-f]{2}\.[0-9] ", node=KV)
    text = "00:1f.0 ISA bridge\n  Flags: bus master\n00:1f.3 Audio device\n  done\n"
    good, *bad = nested(spark, shape, text, text + "done\n", "done\n" + text)
    assert [n["text"] for n in good] == ["00:1f.0 ISA bridge", "00:1f.3 Audio device"] and good[0]["children"][0]["name"] == "Flags" and good[1]["children"][0]["text"] == "done"
    assert bad == ["a line at the top level that isn't a root"] * 2
    rows = Shape("tree", root="^dev").read(captures(spark, "dev0\n  a\nfoo\n"), "report").orderBy("num").collect()
    assert [(r.text, r.depth, r.parent, r.refusal) for r in rows] == [("dev0", 0, None, None), ("a", 1, 1, None), ("foo", 0, None, "a line at the top level that isn't a root")]


def test_a_branch_ends_the_indentation(spark):
    shape = Shape("tree", indent=["| ", "|-", "  ", "`-"], node=Shape("regex", patterns=[r"^ *(?P<pid>[0-9]+) (?P<command>.+)$", r"^(?P<name>\S+)$"]))
    (got,) = nested(spark, shape, "-.slice\n|-user.slice\n| |-  987 /usr/bin/a\n| `-12345 /usr/bin/b --flag\n`-system.slice\n  `-cron.service\n    `-   42 /usr/sbin/cron -f\n")
    user, system = got[0]["children"]
    assert [c["pid"] for c in user["children"]] == ["987", "12345"] and system["children"][0]["children"] == [{"pid": "42", "command": "/usr/sbin/cron -f", "children": []}]
    assert nested(spark, shape, "a\n   b\n") == ["part of an indent"]
    assert "no alternative matches" in nested(spark, shape, "a\n|-  b\n")[0]


def test_nodes_as_pairs_and_typed(spark):
    (got,) = nested(spark, Shape("tree", indent="\t", node=Shape("kv_list", separator=": ")), "Section: one\n\tKey: two\n")
    assert got == [{"name": "Section", "value": "one", "children": [{"name": "Key", "value": "two", "children": []}]}]
    shape = Shape("tree", node=Shape("regex", patterns=[r"^(?P<n>\S+)$"], fields={"n": Field("int", required=True)}))
    good, bad = nested(spark, shape, "1\n  2\n", "1\n  x\n")
    assert good == [{"n": 1, "children": [{"n": 2, "children": []}]}] and "n: not int" in bad
    rows = shape.read(captures(spark, "1\n  2\n")).orderBy("num").collect()
    assert [(r.depth, r.parent, r.n) for r in rows] == [(0, None, 1), (1, 1, 2)]


TWICE = "NAME   SIZE\nab     1\nNAME        SIZE\nlonger name 2\nx           3\n"


@pytest.mark.parametrize("derived", [False, True])
def test_a_repeated_heading_begins_another_aligned_table(spark, derived):
    shape = Shape("aligned", derived=True, fields={"size": Field("int")}) if derived else Shape("aligned", columns=["name", "size"], fields={"size": Field("int")})
    rows = shape.read(captures(spark, TWICE)).orderBy("num").collect()
    assert [(r.num, r.cells["name"] if derived else r.name, r.size) for r in rows] == [(2, "ab", 1), (4, "longer name", 2), (5, "x", 3)]


def test_a_leading_label_of_aligned_tables(spark):
    text = "        total  used\nMem:    10     4\nSwap:   0      0\n"
    for shape, at in ((Shape("aligned", derived=True, leading_label="kind", fields={"total": Field("int")}), lambda r: r.cells["kind"]), (Shape("aligned", columns=["kind", "total", "used"], leading_label="kind", fields={"total": Field("int")}), lambda r: r.kind)):
        rows = shape.read(captures(spark, text)).orderBy("num").collect()
        assert [(at(r), r.total) for r in rows] == [("Mem:", 10), ("Swap:", 0)]
        refused = shape.read(captures(spark, "total  used\n10     4\n"), "report").collect()
        assert all(r.refusal for r in refused)


def test_rules_of_a_box(spark):
    text = "+---+----+\n| n | m  |\n+---+----+\n| {} | 2  |\n+---+----+\n"
    shape = Shape("box", fields={"n": Field("int", required=True), "lacking": Field("int")})
    good, bad, none = (shape.read(captures(spark, t), "report").collect() for t in (text.format(7), text.format("x"), "nothing\n"))
    assert [(r.row, r.n, r.lacking, r.cells["m"], r.refusal) for r in good] == [(1, 7, None, "2", None)]
    assert bad[0].n is None and "n: not int" in bad[0].refusal and none[0].refusal.startswith("neither a rule")


def test_no_setting_is_dropped_silently():
    one = Shape("regex", patterns=["(?P<a>.)"])
    for shape in (
        Shape("tree", fields={"n": Field("int")}), Shape("ltsv", fields={"n": Field("int")}), Shape("table", columns=["a"], leading_label="x"), Shape("regex", patterns=["(?P<a>.)"], unquote=True),
        Shape("box", node=one), Shape("tree", node=Shape("box")), Shape("box", root="x"), Shape("tree", root="(("), Shape("records", start="x", parts={"t": Shape("tree")}), Shape("composite", parts={"a": one}, fields={"a": Field("int")}),
    ):
        assert shape.problems()
    assert not Shape("kv_list", unquote=True, keep_space=True).problems()


def test_pairs_as_their_shape_says(spark):
    rows = Shape("kv_list", unquote=True).read(captures(spark, 'a = "x y"\n')).collect()
    assert [(r.name, r.value) for r in rows] == [("a", "x y")]
    rows = Shape("kv_list", keep_space=True).read(captures(spark, "a = x\n")).collect()
    assert [(r.name, r.value) for r in rows] == [("a ", " x")]


def test_trees_and_boxes_are_written_out_in_definitions():
    made = definition(json.dumps({"shape": {"parse": "tree", "root": "^a", "node": {"parse": "regex", "patterns": ["^(?P<n>.+)$"], "fields": {"n": {"type": "int"}}}}})).shape
    assert made.node.fields["n"].type == "int"
    assert "node" in str(Shape("tree", node=Shape("regex", patterns=["(("])).problems())


PARTS = {
    "map": (Shape("kv_map", separator=":"), "a: 1\nb: 2", {"a": "1", "b": "2"}, "a: 1\na: 2", "a key twice"),
    "ini": (Shape("ini"), "x=1\n[s]\ny=2\n[s]\nz=3", [("", {"x": "1"}), ("s", {"y": "2", "z": "3"})], "[s]\ny=1\ny=2", "a key twice"),
    "headed": (Shape("table", columns=["a", "b"], header=True, fields={"b": Field("int")}), "A B\nx 1\nA  B\ny 2", [("x", 1), ("y", 2)], "A C\nx 1", "another header"),
    "derived": (Shape("table", derived=True, fields={"b": Field("int")}), "A B\nx 1", [({"a": "x", "b": "1"}, 1)], "A B\nx y", "b: not int"),
    "aligned": (Shape("aligned", columns=["a", "b"]), "A   B\nx y z", None, "A   B\nx y  z   w  q\n", None),
    "aligned_derived": (Shape("aligned", derived=True, fields={"b": Field("int")}), "A   B\nx   1\nA     B\nlong  2", [({"a": "x", "b": "1"}, 1), ({"a": "long", "b": "2"}, 2)], "A   B\nx   q", "b: not int"),
    "box": (Shape("box", fields={"n": Field("int")}), "+--+\n|n |\n+--+\n|1 |\n+--+", [({"n": "1"}, 1)], "+--+\n|n |\n+--+\n|x |\n+--+", "n: not int"),
    "csv": (Shape("csv", header=True, fields={"n": Field("int")}), 'n,m\n1,"a\nb"', [({"n": "1", "m": "a\nb"}, 1)], 'n,m\n1,"a', "unexpected end"),
    "tree": (Shape("tree", node=KV), "a: 1\n  b: 2", None, "a: 1\n    b: 2", "a skipped level"),
}


@pytest.mark.parametrize("kind", list(PARTS))
def test_parts_of_a_document(spark, kind):
    part, text, want, odd, why = PARTS[kind]
    head = Shape("regex", Region(limit=1), patterns=["^(?P<title>.+)$"])
    shape = Shape("composite", parts={"head": head, "p": Shape(**{**part.__dict__, "region": Region(skip=1)})})
    good, bad = shape.documents(captures(spark, f"T\n{text}\n", f"T\n{odd}\n"), "report").orderBy("capture_id").collect()
    assert good.refusal is None and good.head[0].title == "T"
    if want is not None:
        assert (good.p if isinstance(want, dict) else [tuple(x) for x in good.p]) == want
    if why:
        assert why in bad.refusal


def test_blocks_of_csv_equal_records(spark):
    texts = ["a,b\n1,2\n3,4\n", "a,b\n1,2\n3,4", "a,b\n1\n", "a,b\n\n1,2\n", "a,b\n1,2,3\n", "a\nx\ny\n", "a,a\n1,2\n", 'a,b\n"1",2\n', "a,b\r\n1,2\r\n", "", "\n", "a,b\n", ",\n,\n", "﻿a,b\n1,2\n", "a,b\n1,2\n\n\n3,4\n", "é,漢\nx,y\n"]
    rows = csv_text.csv_rows(captures(spark, *texts)).collect()
    for k, text in enumerate(texts):
        got = [(r.num, r.cells, r.refusal) for r in rows if r.capture_id == k]
        names, want = None, []
        try:
            for num, values in csv_text.records(text.removeprefix("﻿")):
                if values == [""]:
                    continue
                if names is None:
                    names = csv_text.named(values)
                    continue
                if len(values) > len(names):
                    raise ValueError(f"line {num} has {len(values)} values for {len(names)} columns")
                want.append((num, dict(zip(names, [*values, *[None] * (len(names) - len(values))], strict=True)), None))
        except ValueError as e:
            want = [(0, None, str(e))]
        assert got == want, text
    assert [r.cells for r in csv_text.csv_rows(captures(spark, "1|2\n3|4\n"), "|", header=False).collect()] == [{"column_1": "1", "column_2": "2"}, {"column_1": "3", "column_2": "4"}]
