"""Records of files within bounds, plain and compressed, whole and damaged; output of commands within bounds."""

import bz2
import gzip
import os
import random
import sys

import pytest

from shapewright.sources.bounded import BoundedRecords
from shapewright.sources.command import captured


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(BoundedRecords)
    return spark


def told(spark, path, **options):
    rows = spark.read.format("bounded_records").option("path", str(path)).options(**options).load().collect()
    return sorted(((os.path.basename(r.path), r.place, r.text, r.refusal) for r in rows), key=lambda r: (r[0], r[1], r[3] or ""))


def want(name, data, separator=b"\n"):
    out, place = [], 0
    for k, piece in enumerate(parts := data.split(separator)):
        if k + 1 < len(parts) or piece:
            out.append((name, place, piece.decode(), None))
        place += len(piece) + 1
    return out


def test_ranges_share_the_records(source, tmp_path):
    rng = random.Random(1)
    data = "\n".join("é" * rng.randrange(0, 40) for _ in range(60)).encode() + b"\n"
    (tmp_path / "a").write_bytes(data)
    for size in (40, 300, 10**6):
        assert told(source, tmp_path, range=size) == want("a", data), size
    (tmp_path / "b").write_bytes(b"x\0y\0\0z")
    assert told(source, tmp_path / "b", separator="\0", range=2) == want("b", b"x\0y\0\0z", b"\0")
    (tmp_path / "c").write_bytes(b"")
    assert told(source, tmp_path / "c") == []


def test_long_and_odd_records_are_refusals(source, tmp_path):
    (tmp_path / "a").write_bytes(b"ok\n" + b"x" * 300_000 + b"\nlater\n\xff\xfe\nlast")
    got = told(source, tmp_path, most_record=1000, range=4096)
    assert got == [("a", 0, "ok", None), ("a", 3, None, "a record of over 1000 bytes"), ("a", 300_004, "later", None), ("a", 300_010, None, "not UTF-8"), ("a", 300_013, "last", None)]


@pytest.mark.parametrize(("pack", "kind"), [(gzip.compress, "gzip"), (bz2.compress, "bzip2")])
def test_compressed_files(source, tmp_path, pack, kind):
    data = b"".join(b"line %d of some text\n" % k for k in range(20000))
    (tmp_path / "whole").write_bytes(pack(data))
    assert told(source, tmp_path / "whole") == sorted(want("whole", data))
    (tmp_path / "two").write_bytes(pack(b"a\nb") + pack(b"c\nd\n"))
    assert [r[2] for r in told(source, tmp_path / "two")] == ["a", "bc", "d"]
    (tmp_path / "cut").write_bytes(pack(data)[:-200])
    got, all_ = told(source, tmp_path / "cut"), set(want("cut", data))
    assert [r[3] for r in got if r[3]] == [f"ends within its {kind}"] and all(r in all_ for r in got if r[3] is None and r[2].endswith("text"))
    broken = bytearray(pack(data))
    broken[len(broken) // 2] ^= 0xFF
    (tmp_path / "broken").write_bytes(bytes(broken))
    assert [r[3].split(":")[0] for r in told(source, tmp_path / "broken") if r[3]][:1] in ([f"damaged {kind}"], ["not UTF-8"])
    (tmp_path / "bomb").write_bytes(pack(b"\n".join([b"0" * 999] * 5000)))
    got = told(source, tmp_path / "bomb", most_output=100_000)
    assert [r[3] for r in got if r[3]] == ["inflates to over 100000 bytes"] and len(got) < 120


def test_commands_within_bounds(spark):
    rows = captured(spark, [["echo", "a"], [sys.executable, "-c", "print('x' * 10**7)"], ["sleep", "30"], ["nosuchcommand"], ["sh", "-c", "kill -TERM $$"], ["sh", "-c", "exit 3"]], timeout=5, most=1 << 20).collect()
    assert [(r.status, r.text, r.error) for r in rows[:1]] == [(0, "a\n", None)]
    assert [r.error for r in rows[1:3]] == ["over 1048576 bytes of output", "not done within 5 seconds"] and rows[3].error and rows[3].status is None
    assert (rows[4].status, rows[4].error) == (-15, "ended by SIGTERM") and rows[5].status == 3
