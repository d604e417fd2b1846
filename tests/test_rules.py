import json
import os
import subprocess
import sys
import textwrap
from datetime import datetime, timezone
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, TOP
from shapewright.functions import convert
from shapewright.functions.convert import Field
from shapewright.functions.patterns import Found, PatternError, match_array, translate
from shapewright.functions.text import normal_name, unescaped, without_escapes
from shapewright.operators import aligned, csv_text, parse
from shapewright.operators.lines import Region
from shapewright.plans import identify
from shapewright.plans.build import UsageError, built, number_text
from shapewright.plans.definition import definition, registry
from shapewright.plans.shape import DefinitionError, Shape, changes
from shapewright.sources import readers
from shapewright.sources.readers import format_of


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_numbers(spark):
    assert column(spark, ["12", "+7", "-0", "1.0", "", "0x1", "9" * 20], convert.to_int) == [12, 7, 0, None, None, None, None]
    assert column(spark, ["9" * 30], convert.to_wide_int) == [Decimal("9" * 30)]
    assert column(spark, ["1.5", ".5", "1e3", "NaN", "Infinity", "1.5d", "1e400", "1e-400", "0.0"], convert.to_float) == [1.5, 0.5, 1000.0, None, None, None, None, None, 0.0]
    assert column(spark, ["3,000,023", "30,00", "3000", "1,234.5"], lambda c: convert.ungrouped(c, ",")) == ["3000023", None, "3000", "1234.5"]


def test_durations(spark):
    texts = ["90", "1:30", "01:00:01", "2-03:04:05", "1h 30m", "5m", "250ms", "1:75", "1:99:00", "m", ""]
    got = column(spark, texts, convert.to_duration)
    assert [None if v is None else float(v) for v in got] == [90, 90, 3601, 183845, 5400, 300, 0.25, None, None, None, None]


def test_rules_keep_absent_and_empty_apart(spark):
    assert column(spark, ["", None, " - "], lambda c: convert.compiled(c, Field(null_if=("-",)), "k")[0]) == ["", None, None]
    assert column(spark, ["", None, "x"], lambda c: convert.compiled(c, Field(required=True), "k")[1].isNotNull()) == [True, True, False]
    p = translate("^k(?P<v>=(?P<w>.*))?$")
    assert column(spark, ["k", "k=", "k=v"], lambda c: Found(match_array(c, [p]), (p,)).group(0, "w")) == [None, "", "v"]
    q = translate(r"(?P<a>x+)|(?m)^(?P<b>y*)(?P<c>z?)$")
    got = [column(spark, ["-x", "\n", "", "yz", "q\nyy"], lambda c, n=n: Found(match_array(c, [q]), (q,)).group(0, n)) for n in "abc"]
    assert got == [["x", None, None, None, None], [None, "", "", "y", ""], [None, "", "", "z", ""]] or got[0] == ["x", None, None, None, None]


@pytest.mark.parametrize("pattern", [r"^\s*a$", r"[[:alpha:]]+\d", r"[a[b]+", r"(?i)HeLLo", r"(?m)^b$", r".", r"\S+\s\S", r"x|yz?$"])
def test_patterns_match_as_in_the_linear_dialect(spark, pattern):
    texts = ["a", " a", "a\n", "\x0ba", "x1", "[", "b", "a\nb\nc", "hello", "\r", "", "yz\n", "y ", "p q", "p\x0bq"]
    want = [r[0] for r in duckdb.sql("select regexp_matches(t, $p) from (select unnest($t) as t)", params={"p": pattern, "t": texts}).fetchall()]
    assert column(spark, texts, translate(pattern).matches) == want


def test_patterns_refuse():
    for bad in (r"(?=a)", r"(a)\1", "(?P<a>x)(?P<a>y)"):
        with pytest.raises(PatternError):
            translate(bad)


def captures(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "capture_id int, text string")


@pytest.mark.parametrize("change", [lambda t: t, lambda t: "﻿" + t, lambda t: t.replace("\n", "\r\n"), lambda t: t.rstrip("\n"), lambda t: "\n \n" + t + "\n\n"])
def test_same_text_in_other_dress(spark, change):
    shape = Shape("table", columns=["a", "b"], fields={"a": Field("int")})
    rows = shape.read(captures(spark, change("1 x\n2 y z\n"))).select("a", "b").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, "y z")]


def test_a_foreign_line_is_refused_even_if_unselected(spark):
    shape = Shape("regex", patterns=[r"^(?P<a>\d+)$"], fields={"a": Field("int")})
    with pytest.raises(Exception, match="no alternative"):
        shape.read(captures(spark, "1\nfoo\n")).select("num").collect()
    report = shape.read(captures(spark, "1\nfoo\n"), "report").orderBy("num").collect()
    assert [r.refusal is None for r in report] == [True, False]


def test_regions(spark):
    shape = Shape("regex", Region(fold=r"^ ", ignore=("^#", "^x$"), after="^B$"), [r"^(?P<t>.*)$"])
    rows = shape.read(captures(spark, "x\nB\n# no\none\n two\n\nthree")).collect()
    assert [(r.num, r.t) for r in rows] == [(4, "one two"), (7, "three")]
    assert shape.read(captures(spark, "", "x")).collect() == []
    with pytest.raises(Exception, match="no part reads"):
        shape.read(captures(spark, "no begin")).collect()


def test_trees_refuse_skipped_levels(spark):
    rows = Shape("tree").read(captures(spark, "a\n  b\n    c\n  d\n      e\n"), "report").orderBy("num").collect()
    assert [(r.depth, r.parent, r.refusal) for r in rows] == [(0, None, None), (1, 1, None), (2, 2, None), (1, 1, None), (3, 0, "a skipped level")]


def test_csv_rules():
    assert list(csv_text.records('a,b\n"x\ny","p""q"\n,\n')) == [(1, ["a", "b"]), (2, ["x\ny", 'p"q']), (4, ["", ""])]
    assert csv_text.named(["a", "a", ""]) == ["a", "a_2", "column_3"]
    for bad in ('"open', '"a"b', "a\rb\n"):
        with pytest.raises(ValueError):
            list(csv_text.records(bad))


def test_aligned_and_box():
    assert aligned.width("日本é") == 5
    starts = aligned.column_starts("NAME  SIZE", 2)
    assert aligned.cut("日本    12", starts) == ["日本", "12"]
    assert aligned.box_table(["+---+---+", "| A | B |", "+---+---+", "| 1 | x |", "|   | y |", "+---+---+"]) == [{"a": "1", "b": "x\ny"}]
    with pytest.raises(ValueError):
        aligned.box_table(["no table"])


def test_names_and_escapes(spark):
    assert [normal_name(n) for n in ("Use%", "1K-blocks", " Mounted on ")] == ["use_percent", "1k_blocks", "mounted_on"]
    assert column(spark, ["\x1b[31mred\x1b[0m", "\x1b]0;t\x07x", "\x1b[31"], without_escapes) == ["red", "x", "\x1b[31"]


def test_json(spark):
    numbers = {1.5: "1.5", 100.0: "100", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-7: "1e-7", 1e-6: "0.000001", 1.2345678901234567e-6: "0.0000012345678901234567", 0.1: "0.1", 2.0**60: "1152921504606847000", -1.5e22: "-1.5e+22", -123456789012345680.0: "-123456789012345680", 0.1 + 0.2: "0.30000000000000004"}
    assert column(spark, list(numbers), number_text, "double") == list(numbers.values())
    assert column(spark, ['a"<> '], lambda c: built(("=", "k", c)))[0].startswith('{"k":"a\\"<>')
    with pytest.raises(UsageError):
        built(("=", "a", F.lit("1")), ("path", "/a/b", F.lit("2")))


def test_definitions(spark):
    with pytest.raises(DefinitionError, match="columns"):
        Shape("table").checked()
    with pytest.raises(DefinitionError, match="no records in records"):
        Shape("records", start="a", parts={"x": Shape("records", start="b", parts={"y": Shape("kv_list")})}).checked()
    shape = Shape("table", columns=["a", "b"], fields={"a": Field("int", required=True)})
    wide = Shape("table", columns=["a", "b", "c"], fields={"a": Field("float", required=True)})
    assert shape.schema(spark)["a"].dataType.simpleString() == "bigint"
    assert changes(shape.schema(spark), wide.schema(spark)) == [("a", "type"), ("c", "added")]


def test_formats():
    assert [format_of(p) for p in ("x/a.CSV.gz", ".json", "b.ndjson", "c.txt")] == [("csv", "gzip"), (None, None), ("jsonl", None), (None, None)]


def test_times(spark):
    def at(text, layout, **more):
        return column(spark, [text], lambda c: convert.to_time(c, layout, **more))[0]

    assert at("2024-02-29 10:00:00.25", "yyyy-MM-dd HH:mm:ss.SS") == "2024-02-29T10:00:00.25Z"
    assert at("2023-02-29 10:00:00", "yyyy-MM-dd HH:mm:ss") is None
    assert at("2024-01-01 23:30 -0330", "yyyy-MM-dd HH:mm xx") == "2024-01-01T23:30:00-03:30"
    assert at("2024-01-01 23:30 EST", "yyyy-MM-dd HH:mm z", zones={"EST": "-0500"}) == "2024-01-01T23:30:00-05:00"
    assert at("2024-01-01 23:30 GMT", "yyyy-MM-dd HH:mm z") == "2024-01-01T23:30:00Z"
    assert at("2024-01-01 23:30 EST", "yyyy-MM-dd HH:mm z") == "2024-01-01 23:30 EST"
    assert at("nothing EST", "yyyy-MM-dd HH:mm z") is None
    now = datetime(2025, 1, 2, tzinfo=timezone.utc)
    assert at("Jan 02 23:00", "MMM dd HH:mm", recent=now) == "2025-01-02T23:00:00Z"
    assert at("Jan 03 23:00", "MMM dd HH:mm", recent=now) == "2024-01-03T23:00:00Z"
    assert at("Feb 29 00:00", "MMM dd HH:mm", recent=now) == "2024-02-29T00:00:00Z"
    assert at("Feb 29 00:00", "MMM dd HH:mm", year=2023) is None
    with pytest.raises(ValueError):
        convert.offset_seconds("+9")


def test_escapes_of_strings(spark):
    def undo(values, **more):
        return column(spark, values, lambda c: unescaped(c, {r"\n": "\n", r"\\": "\\", r"\nn": "N"}, **more))

    assert undo([r"a\nb", r"\nn\\n", "plain", "", None, r"a\q", "end\\", r"\101"]) == ["a\nb", "N\\n", "plain", "", None, None, None, None]
    assert undo([r"\303\251\101", r"\303", r"\477", "é\\n"], octal=True) == ["éA", None, None, "é\n"]
    assert undo(['"a\\nb"', r"a\qb", '"', '""'], quote='"') == ["a\nb", r"a\qb", '"', ""]
    shape = Shape("regex", patterns=[r"^(?P<mark>\\?)(?P<sum>\w+)  (?P<name>.*)$"], fields={"name": Field(unescape={r"\n": "\n"}, unescape_when="mark")})
    rows = shape.read(captures(spark, "\\\\ab  x\\ny\nab  x\\ny\n".replace("\\\\", "\\"))).orderBy("num").collect()
    assert [r.name for r in rows] == ["x\ny", r"x\ny"]


def test_definitions_from_text(spark, tmp_path):
    good = {"shape": {"parse": "table", "columns": ["a", "b"], "fields": {"a": {"type": "int", "null_if": ["-"]}, "b": {"unescape": {"\\n": "\n"}}}, "region": {"ignore": ["^#"]}}, "signature": {"all": ["^[0-9]"], "priority": 2}}
    for place, text in {"one/plain": json.dumps(good), "one/bad": '{"shape": {"parse": "table", "colums": []}}', "two/twice": '{"shape": 1, "shape": 2}'}.items():
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "parser.json").write_text(text)
    found, wrong = registry(spark, str(tmp_path), source=3)
    assert list(found) == [("one", "plain")] and len(wrong) == 2
    assert any("shape.colums: unknown" in w for w in wrong.values()) and any("stands twice" in w for w in wrong.values())
    own = found["one", "plain"]
    assert (own.signature.parser, own.signature.source, own.signature.priority) == ("one", 3, 2)
    assert [tuple(r) for r in own.shape.read(captures(spark, "# no\n1 x\\ny\n- z\n")).orderBy("num").select("a", "b").collect()] == [(1, "x\ny"), (None, "z")]
    for text in ("[]", "{", '{"shape": {"parse": "tabel"}}', '{"shape": {"parse": "regex", "patterns": ["(a"]}}', '{"shape": {"parse": "table", "columns": "a"}}', '{"shape": {"parse": "csv", "fields": {"a": {"year": 1}}}}'):
        with pytest.raises(DefinitionError):
            definition(text)


def test_each_pattern_is_tried_once_a_line(spark):
    rules = {"n": Field("int", required=True), "m": Field("float"), "w": Field("bool")}
    lines = spark.createDataFrame([(0, 1, "a 1 2.5 yes"), (0, 2, "b 2")], "capture_id int, num int, line string")
    rows = parse.settle_refusals(parse.regex_lines(lines, [r"^a (?P<n>\d+) (?P<m>\S+) (?P<w>\w+)$", r"^b (?P<n>\d+)(?P<x> .*)?$"], rules))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2 and plan.count("regexp_extract") == 0
    assert [tuple(r) for r in rows.orderBy("num").select("n", "m", "w", "x").collect()] == [(1, 2.5, True, None), (2, None, None, None)]


def test_lines_that_no_part_reads_are_refused(spark):
    parts = {"a": Shape("regex", Region(until="^B$"), ["^(?P<x>a.*)$"]), "b": Shape("regex", Region(after="^B$", limit=1), ["^(?P<y>.*)$"])}
    shape = Shape("composite", parts=parts)
    told = shape.documents(captures(spark, "a1\nB\nb1\n", "a1\nB\nb1\nlost\nlost too\n"), "report").orderBy("capture_id").collect()
    assert told[0].refusal is None and told[0].a[0].x == "a1" and told[0].b[0].y == "b1"
    assert told[1].refusal == 'lines that no part reads: line 4 "lost", line 5 "lost too"'
    by_part = shape.read_parts(captures(spark, "a1\nB\nb1\nlost\n"), "report")["a"].collect()
    assert [r.refusal for r in by_part] == ['lines that no part reads: line 4 "lost"']
    loose = Shape("regex", Region(after="^Features for "), ["^(?P<x>.*)$"])  # the heading isn't described whole
    assert "line 1" in loose.read(captures(spark, "Features for eth0:\nx\n"), "report").first().refusal


def test_many_definitions(spark):
    signatures = [identify.Signature(f"c{k}", "v", all=(rf"^header{k} +\w+$", r"^\d+"), none=(r"^!",)) for k in range(758)]
    texts = [f"header{k} x\n12\n" for k in (0, 7, 757)] + ["header9 x\n!\n12\n", "nothing\n"]
    told = identify.identified(captures(spark, *texts), signatures)
    assert [r.parser for r in sorted(told.collect(), key=lambda r: r.capture_id)] == ["c0", "c7", "c757", None, None]
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [identify.required_text(p) for p in (r"^Filesystem\s+Size", "a|b", r"x?yz+[ab]\.c{2}", "(?i)abc")] == ["Filesystem", "", "yz", ""]


def test_refusals_of_headers_and_documents(spark):
    shape = Shape("table", derived=True)
    assert [r.refusal for r in shape.read(captures(spark, "A A\n1 2\n"), "report").collect()] == ["headings that are empty or alike"]
    assert shape.read(captures(spark, "A B\n1\n"), "report").first().refusal.startswith("too few cells")
    with pytest.raises(DefinitionError):
        Shape("table", columns=["a"], rename={"a": "b"}).checked()
    odd = captures(spark, '{"b":1.10,"a":2}', '{"a":1,"a":2}', '"\\ud83d\\ude00"', '"\\ud83d"', '"\\\\ud83d"', "1 2", "")
    assert [r.refusal for r in readers.json_documents(odd).orderBy("capture_id").collect()] == [None, "not JSON", None, "half of a surrogate pair", None, "text after the value", "not JSON"]


def run_apart(folder, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=folder, env=env, capture_output=True, text=True, timeout=300, check=False)


def test_workers_are_given_the_package(tmp_path):
    done = run_apart(tmp_path, f"""
        import sys; sys.path.insert(0, {str(TOP)!r})
        from pyspark.sql import SparkSession
        from shapewright import queries
        s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        print(*[queries.QUERIES[q](s, {SMALL!r}).count() for q in ("csv_roundtrip_orders", "box_nation", "aligned_nation")])
    """)
    assert done.stdout.split() == ["1500", "25", "25"], done.stderr[-2000:]


def test_core_queries_stand_without_the_operators(tmp_path):
    done = run_apart(tmp_path, f"""
        import sys; sys.path.insert(0, {str(TOP)!r}); sys.modules["xxhash"] = None
        import __spark_entry__ as e
        from shapewright import queries
        assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
        print(len(e.queries()) >= 70)
    """)
    assert done.stdout.split() == ["True"], done.stderr[-2000:]
