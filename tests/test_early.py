"""Streams that give what is ready before a capture ends, hold little, and tell their format from the first lines."""

import json
import random

import pytest
from shapewright.functions.convert import Field
from shapewright.operators.csv_text import quote_open
from shapewright.operators.lines import Region
from shapewright.plans import identify
from shapewright.plans.choice import Head
from shapewright.plans.identify import Signature
from shapewright.plans.shape import Shape
from shapewright.streaming.stream import stream_identified, stream_parts
from shapewright.streaming.units import Reader, Refused
from test_stream import SCHEMA, STREAMED

PING = Shape("composite", parts={
    "destination": Shape("regex_input", Region(limit=1), patterns=[r"^PING (?P<name>\S+)$"]),
    "replies": Shape("regex", Region(skip=1, until=r"^--- \S+ statistics ---$"), patterns=[r"^reply seq=(?P<seq>\d+) time=(?P<time_ms>\S+)$", r"^From (?P<from>\S+) seq=(?P<seq>\d+) (?P<error>.+)$"], fields={"seq": Field("int"), "time_ms": Field("float")}),
    "statistics": Shape("regex_input", Region(after=r"^--- \S+ statistics ---$"), patterns=[r"\A(?P<sent>\d+) sent, (?P<received>\d+) received\z"], fields={"sent": Field("int"), "received": Field("int")}),
})
PINGED = "PING host\nreply seq=1 time=0.5\nFrom gw seq=2 Destination Host Unreachable\nreply seq=3 time=1.25\n--- host statistics ---\n3 sent, 2 received\n"


def numbered(text):
    return list(enumerate(text.split("\n")[:-1], 1))


def test_units_come_with_their_lines():
    reader, came = Reader(PING), []
    for line in numbered(PINGED):
        came.append([(part, [n for n, _ in own]) for part, own in reader.feed([line], False)])
    assert came == [[("destination", [1])], [("replies", [2])], [("replies", [3])], [("replies", [4])], [], []]
    assert list(reader.feed([], True)) == [("statistics", [(6, "3 sent, 2 received")])]
    with pytest.raises(Refused, match="line 2"):
        list(Reader(Shape("composite", parts={"one": Shape("regex", Region(limit=1), patterns=["(?P<a>.+)"])})).feed(numbered("a\nb\n"), False))


@pytest.mark.parametrize("name", [n for n in STREAMED if n not in ("regex", "pairs", "labels", "table")])
def test_batches_cut_anywhere_give_the_same_units(name):
    shape, text = STREAMED[name]
    lines = numbered(text * 3 if shape.parse in ("tree", "csv", "kv_list") else text)
    want = list(Reader(shape).feed(lines, True))
    rng = random.Random(name)
    for _ in range(20):
        cuts = sorted(rng.randrange(len(lines) + 1) for _ in range(3))
        state, got = None, []
        for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True):
            reader = Reader(shape, state)
            got += reader.feed(lines[a:b], b == len(lines) and a == cuts[-1])
            state = json.loads(json.dumps(reader.state()))
        assert got == want


@pytest.mark.parametrize(
    ("shape", "text"),
    [
        (Shape("regex", Region(fold="^ "), patterns=["(?P<x>.*)"]), "abc\n" + " def\n" * 100),
        (Shape("records", start="^start", parts={"p": Shape("kv_list")}), "start=1\n" + "k=v\n" * 100),
        (Shape("tree", indent=" "), "root\n" + " leaf\n" * 100),
        (Shape("csv"), 'x\n"open\n' + "more\n" * 100),
        (Shape("composite", parts={"p": Shape("csv")}), 'x\n"open\n' + "more\n" * 100),
        (Shape("composite", parts={"p": Shape("kv_map")}), "k=v\n" * 100),
        (Shape("kv_map"), "k=v\n" * 100), (Shape("ini"), "k=v\n" * 100),
        (Shape("box"), "+---+\n" + "| a |\n" * 100),
        (Shape("regex", Region(skip_blank=False), patterns=["(?P<x>.*)"]), "a\n" + "\n" * 300),
        (Shape("composite", parts={"p": Shape("kv_map"), "q": Shape("kv_map")}), "k=vé\n" * 20),  # 120 bytes in either part
    ],
)
def test_what_is_held_is_bounded(shape, text):
    lines = numbered(text)
    state = None
    with pytest.raises(Refused, match="exceeds 200 bytes"):
        for line in lines:
            reader = Reader(shape, state, most=200)
            list(reader.feed([line], False))
            state = reader.state()
    list(Reader(shape, most=100000).feed(lines, True))


def test_what_is_released_is_given_back():
    shape = Shape("records", start="^start", parts={"p": Shape("kv_list")})
    assert len(list(Reader(shape, most=40).feed(numbered("start=1\nk=v\n" * 100), True))) == 100


@pytest.mark.parametrize(("lines", "open_"), [(['a,"b'], True), (['a,"b', 'c"'], False), (['"a""', '"', "x"], False), (['a"b'], False), (['x,"', '",y,"'], True), (['x,"', '",y,""'], False), (['"', '""', '"'], False)])
def test_open_quotes_line_by_line(lines, open_):
    inside = False
    for line in lines:
        inside = quote_open(line, ",", inside)
    assert inside is open_


def feed(spark, tmp_path, texts, build, ends=True, batches=3):
    rows = [(k, n, t, False) for k, text in enumerate(texts) for n, t in numbered(text)] + [(k, 9999, None, True) for k in range(len(texts)) if ends]
    rows.sort(key=lambda r: r[1])
    for part in range(batches):
        own = rows[len(rows) * part // batches : len(rows) * (part + 1) // batches]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    made = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    return spark.read.schema(made.schema).parquet(str(tmp_path / "out"))


def test_a_composite_comes_part_by_part(spark, tmp_path):
    got = feed(spark, tmp_path, [PINGED], lambda s: stream_parts(s, PING)).orderBy("num").collect()
    assert [(r.part, json.loads(r.json)) for r in got] == [
        ("destination", {"name": "host"}), ("replies", {"seq": 1, "time_ms": 0.5, "from": None, "error": None}), ("replies", {"seq": 2, "time_ms": None, "from": "gw", "error": "Destination Host Unreachable"}),
        ("replies", {"seq": 3, "time_ms": 1.25, "from": None, "error": None}), ("statistics", {"sent": 3, "received": 2}),
    ]


def test_parts_come_before_the_capture_ends(spark, tmp_path):
    got = feed(spark, tmp_path, [PINGED, "PING other\nreply seq=9 time=1\n"], lambda s: stream_parts(s, PING), ends=False).collect()
    assert sorted((r.capture_id, r.part) for r in got) == [(0, "destination"), (0, "replies"), (0, "replies"), (0, "replies"), (1, "destination"), (1, "replies")]


def test_a_line_that_no_part_reads_ends_its_capture_alone(spark, tmp_path):
    parts = Shape("composite", parts={"one": Shape("regex", Region(limit=1), patterns=["(?P<a>.+)"]), "two": Shape("kv_map", Region(skip=1, limit=1))})
    got = feed(spark, tmp_path, ["a\nk=v\nstray\nmore\n", "b\nk=v\n"], lambda s: stream_parts(s, parts, "report")).collect()
    assert sorted((r.capture_id, r.part, r.json) for r in got if not r.refusal) == [(0, "one", '{"a":"a"}'), (0, "two", '{"k":"v"}'), (1, "one", '{"a":"b"}'), (1, "two", '{"k":"v"}')]
    assert [r.refusal for r in got if r.refusal] == ['lines that no part reads: line 3 "stray"']


KINDS = [
    (Signature("ping", "plain", all=(r"^PING \S+$",)), PING),
    (Signature("pairs", "plain", all=(r"^\w+=",), none=(r"^PING",), window=3), Shape("kv_list")),
    (Signature("pairs", "long", priority=5, all=(r"^\w+=", r"^end=\d+$"), window=3), Shape("kv_list")),
]


def test_a_stream_tells_its_format(spark, tmp_path):
    texts = [PINGED, "a=1\nb=2\nc=3\nd=4\n", "a=1\nend=2\n", "nothing\n", "a=1\n"]
    got = feed(spark, tmp_path, texts, lambda s: stream_identified(s, KINDS, "report")).collect()
    kinds = {k: {r.parser for r in got if r.capture_id == k} for k in range(len(texts))}
    assert kinds == {0: {"ping/plain"}, 1: {"pairs/plain"}, 2: {"pairs/long"}, 3: {None}, 4: {"pairs/plain"}}
    assert len([r for r in got if r.capture_id == 1]) == 4 and [r.refusal for r in got if r.capture_id == 3] == ["no definition matches"]


def drawn_text(rng):
    return [rng.choice(["PING x", "a=1", "end=2", "", "stray", "--- q"]) for _ in range(rng.randrange(1, 9))]


def test_no_line_that_comes_changes_a_choice(spark):
    signatures = [s for s, _ in KINDS] + [Signature("stray", "any", source=1, any=("^stray", "^--- "), window=4), Signature("whole", "all", all=(r"\Aa=1\nend=2\z",), source=0, priority=1, window=3)]
    rng = random.Random(5)
    texts = [drawn_text(rng) for _ in range(400)]
    rows = spark.createDataFrame([(k, "\n".join(t) + "\n") for k, t in enumerate(texts)], "capture_id int, text string")
    want = {r.capture_id: (r.parser, r.variant, r.refusal) for r in identify.identified(rows, signatures).collect()}
    early = 0
    for k, lines in enumerate(texts):
        head, told = Head(signatures), None
        for n, line in enumerate(lines, 1):
            head.add(line)
            told = told or head.choice(False)
            early += told is not None and n < len(lines)
        number, why = told or head.choice(True)
        s = signatures[number] if number is not None else None
        assert (s and s.parser, s and s.variant, why) == want[k], lines
    assert early > 100


def test_many_definitions_choose_as_one_by_one(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    signatures = [Signature(f"p{k % 20}", f"v{k}", priority=k % 3, all=(rf"^{rng.choice(words)} \d+$",), any=(rng.choice(words), rng.choice(words)), none=(rf"^{rng.choice(words)}x",) if k % 4 == 0 else (), window=rng.choice([2, 5]), os=("linux",) if k % 7 == 0 else ()) for k in range(80)]
    texts = [(k, "\n".join(f"{rng.choice(words)}{rng.choice(['', 'x'])} {rng.randrange(9)}" for _ in range(6)), rng.choice(["linux", "bsd"])) for k in range(300)]
    rows = spark.createDataFrame([*texts, (999, None, "linux")], "capture_id int, text string, os string")
    got = sorted(map(tuple, identify.candidates(rows, signatures).collect()))
    monkeypatch.setattr(identify, "MANY", 10**6)
    assert got == sorted(map(tuple, identify.candidates(rows, signatures).collect())) and len(got) > 50
