"""Files of strict CSV, cut anywhere, against the records of their whole texts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shapewright.functions.convert import Field
from shapewright.operators import csv_text
from shapewright.sources import csv_files as cut_files
from shapewright.sources.csv_files import csv_files


@pytest.fixture
def small_cuts(spark):
    """Spark cuts files every 64 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def plainly(text):
    """Rows of a text read as a whole, one record after the other."""
    names, out, num, held = None, [], 0, []
    lines = text.removeprefix("﻿").split("\n")
    if lines[-1] == "":
        lines.pop()
    for k, line in enumerate(lines, 1):
        held.append(line)
        if csv_text.quote_open(line, ",", len(held) > 1):
            continue
        num = k - len(held) + 1
        try:
            values = next(csv_text.records("\n".join(held) + "\n"))[1]
        except ValueError:
            values = None
        held = []
        if values == [""]:
            continue
        if names is None:
            names = csv_text.named(values)
        elif values is None or len(values) > len(names):
            out.append((num, None))
        else:
            out.append((num, dict(zip(names, [*values, *[None] * (len(names) - len(values))], strict=True))))
    if held:
        out.append((len(lines) - len(held) + 1, None))
    return out


def drawn(rng, rows):
    cell = lambda: rng.choice(["x", "", "long words here", '"q,1"', '"a\nb"', '"say ""no"""', '"' + "line\n" * rng.randrange(1, 60) + '"', "é漢"])
    return "a,b,c\n" + "".join(",".join(cell() for _ in range(rng.choice([3, 3, 3, 2]))) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(rows))


def test_files_cut_anywhere(small_cuts, tmp_path):
    rng = random.Random(3)
    texts = [drawn(rng, 60) for _ in range(6)]
    texts += ["", "a,b\n", "﻿\"a\",b\n1,2\n", "\n\na,b\n\n1,2\n3\n", 'a,b\n1,"x" y\n2,3\n1,2,3\n4,5\n', 'a,b\n1,2\n3,"open\n' + "more\n" * 50, "a,b\n" + "1,2\n" * 300, 'a,b\n"' + "z\n" * 500 + '",2\n5,6']
    for k, text in enumerate(texts):
        (tmp_path / f"f{k}.csv").write_text(text, newline="")
    got = csv_files(small_cuts, str(tmp_path)).collect()
    for k, text in enumerate(texts):
        mine = sorted(((r.num, r.cells, r.refusal) for r in got if r.path.endswith(f"/f{k}.csv")), key=lambda r: r[0])
        assert [r[:2] for r in mine] == plainly(text), k
        assert all((cells is None) == (why is not None) for _, cells, why in mine)
    assert small_cuts.read.text(str(tmp_path)).rdd.getNumPartitions() > 40


def test_rules_and_names_of_files(small_cuts, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n" + "".join(f'{k},"text {k}"\n' for k in range(200)) + "x,bad\n,none\n")
    rows = csv_files(small_cuts, str(tmp_path), rules={"n": Field("int")}).orderBy("num").collect()
    assert [r.n for r in rows[:200]] == list(range(200)) and "n: not int" in rows[200].refusal and rows[201].n is None and rows[201].refusal is None
    assert csv_files(small_cuts, str(tmp_path), rules={"lacking": Field()}).filter(F.col("refusal").contains("no column lacking")).count() == 202
    assert csv_files(small_cuts, str(tmp_path), columns=["p", "q"]).filter("cells['p'] = 'n'").count() == 1
    assert csv_files(small_cuts, str(tmp_path), header=False).filter("cells['column_1'] = 'n'").count() == 1


def cut_batches(lines, size, taken):
    """A cut's lines in batches; ``taken`` counts those that were asked for."""
    for k in range(0, len(lines), size):
        taken.append(k)
        own = lines[k : k + size]
        yield pa.RecordBatch.from_pydict({"path": ["p"] * len(own), "start": [0] * len(own), "text": own, "first": [1] * len(own), "open": [False] * len(own), "since": pa.array([-1] * len(own), pa.int64())})


def test_a_cut_is_never_held_whole():
    taken = []
    lines = [f'{k},"{"x" * 1000}' if k % 2 else f'{"y" * 1000}",{k}' for k in range(1, 40_001)]
    made = cut_files._read(",")(cut_batches(lines, 1000, taken))
    first = next(made)
    assert first.num_rows and len(taken) < 8
    assert first.num_rows + sum(b.num_rows for b in made) == 20_000 and len(taken) == 40


def test_a_large_record_is_refused_and_not_held_wherever_it_lies(monkeypatch):
    monkeypatch.setattr(cut_files, "MOST_BYTES", 500)
    lines = ["a,b", '1,"', *["z" * 9] * 60, '",2', "3,4", '5,"', *["z" * 9] * 60]
    rows = [r for b in cut_files._read(",")(cut_batches(lines, 7, [])) for r in b.to_pylist()]
    assert [(r["num"], r["cells"], r["refusal"]) for r in rows] == [(1, ["a", "b"], None), (2, None, "line 2: a record of over 64 MiB"), (64, ["3", "4"], None)]
    rows = [r for b in cut_files._pieces(",")(cut_batches(lines, 7, [])) for r in b.to_pylist()]
    assert [(r["since"], r["text"], r["size"], r["whole"]) for r in rows] == [(65, None, 603, False)]
