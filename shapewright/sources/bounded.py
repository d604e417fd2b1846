"""Records of files as a Spark data source that holds no more than a bound.

    spark.dataSource.register(BoundedRecords)
    spark.read.format("bounded_records").option("path", "...").load()

Plain files are read in ranges, by many tasks; a record belongs to the range it
begins in. Compressed ones (gzip, bzip2) are inflated step by step by one task
each. A record is never held beyond ``most_record`` bytes: one that is longer is a
refusal, and reading goes on after it. Damage, a file that ends within its
compression, and one that inflates to over ``most_output`` bytes are refusals too,
after the records that stand before them.

Rows: path, place (the byte, of the inflated text, at which the record begins),
text, refusal. Options: path (a file or a folder), separator (a byte, default
newline), most_record, most_output, range (bytes of a task's share).
"""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.lines import MOST_BYTES, MOST_RECORD_BYTES

CHUNK = 1 << 16
SCHEMA = pa.schema([("path", pa.string()), ("place", pa.int64()), ("text", pa.string()), ("refusal", pa.string())])
#: How compressed files begin.
MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2"}


class Damaged(ValueError):
    """What a compressed file can't be read beyond."""


@dataclass
class Share(InputPartition):
    """Part of a plain file, or a compressed one."""

    path: str
    begins: int
    ends: int
    kind: str | None


def inflated(chunks: Iterator[bytes], kind: str, most: int) -> Iterator[bytes]:
    """The text of a compressed file, some of it at a time; several streams may follow each other."""
    new = (lambda: zlib.decompressobj(31)) if kind == "gzip" else bz2.BZ2Decompressor
    engine, total, begun, rest = new(), 0, False, b""
    for chunk in chunks:
        rest = rest + chunk
        while rest or (begun and kind == "bzip2" and not engine.needs_input and not engine.eof):
            try:
                out = engine.decompress(rest, CHUNK)
            except (zlib.error, OSError, ValueError) as e:
                raise Damaged(f"damaged {kind}: {e}") from e
            begun = True
            total += len(out)
            if total > most:
                raise Damaged(f"inflates to over {most} bytes")
            if out:
                yield out
            if engine.eof:
                rest, engine, begun = engine.unused_data, new(), False
            elif kind == "gzip":
                rest = engine.unconsumed_tail
            else:
                rest = b""
                if engine.needs_input:
                    break
    if begun:
        raise Damaged(f"ends within its {kind}")


class _Held:
    """One record as it comes, up to a bound."""

    def __init__(self, most: int):
        self.most, self.kept, self.long = most, bytearray(), False

    def add(self, piece: bytes) -> None:
        self.long = self.long or len(self.kept) + len(piece) > self.most
        if self.long:
            self.kept.clear()
        else:
            self.kept += piece

    def taken(self) -> bytes | None:
        out = None if self.long else bytes(self.kept)
        self.kept.clear()
        self.long = False
        return out


def records(chunks: Iterator[bytes], place: int, ends: int | None, separator: bytes, most: int) -> Iterator[tuple[int, bytes | None]]:
    """(place, record) of what begins before ``ends``; None for a record of over ``most`` bytes."""
    held, at = _Held(most), place
    for chunk in chunks:
        begun = 0
        while (cut := chunk.find(separator, begun)) >= 0:
            held.add(chunk[begun:cut])
            yield at, held.taken()
            begun = cut + 1
            at = place + begun
            if ends is not None and at >= ends:
                return
        held.add(chunk[begun:])
        place += len(chunk)
    if at < place:
        yield at, held.taken()


def _chunks(stream) -> Iterator[bytes]:  # noqa: ANN001
    while chunk := stream.read(CHUNK):
        yield chunk


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.separator = options.get("separator", "\n").encode()
        self.most_record = int(options.get("most_record", MOST_RECORD_BYTES))
        self.most_output = int(options.get("most_output", MOST_BYTES))
        self.range = int(options.get("range", 128 << 20))
        if len(self.separator) != 1:
            raise ValueError("the separator is one byte")

    def partitions(self) -> list[Share]:
        files, at = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(at)
        if found.type == fs.FileType.Directory:
            found = [f for f in files.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        elif found.type == fs.FileType.File:
            found = [found]
        else:
            raise FileNotFoundError(self.path)
        shares: list[Share] = []
        for f in sorted(found, key=lambda f: f.path):
            with files.open_input_stream(f.path, compression=None) as stream:
                head = stream.read(3)
            kind = next((k for magic, k in MAGIC.items() if head.startswith(magic)), None)
            if kind:
                shares.append(Share(f.path, 0, f.size, kind))
            else:
                shares += [Share(f.path, a, min(a + self.range, f.size), None) for a in range(0, f.size, self.range)]
        return shares

    def _told(self, share: Share) -> Iterator[tuple[int, str | None, str | None]]:
        files, _ = fs.FileSystem.from_uri(self.path)
        if share.kind:
            with files.open_input_stream(share.path, compression=None) as stream:
                yield from self._read(inflated(_chunks(stream), share.kind, self.most_output), 0, None)
            return
        with files.open_input_file(share.path) as stream:
            begins = share.begins
            if begins:  # the record that runs into the range is the one before's
                stream.seek(begins - 1)
                at = begins - 1
                for chunk in _chunks(stream):
                    if (cut := chunk.find(self.separator)) >= 0:
                        begins = at + cut + 1
                        break
                    at += len(chunk)
                else:
                    return
                if begins >= share.ends:
                    return
                stream.seek(begins)
            yield from self._read(_chunks(stream), begins, share.ends)

    def _read(self, chunks: Iterator[bytes], begins: int, ends: int | None) -> Iterator[tuple[int, str | None, str | None]]:
        place = begins
        try:
            for place, record in records(chunks, begins, ends, self.separator, self.most_record):
                if record is None:
                    yield place, None, f"a record of over {self.most_record} bytes"
                    continue
                try:
                    yield place, record.decode(), None
                except UnicodeDecodeError:
                    yield place, None, "not UTF-8"
        except Damaged as why:
            yield place, None, str(why)

    def read(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        if share is None:  # nothing to read
            return
        rows: list[tuple] = []
        size = 0
        for place, text, why in self._told(share):
            rows.append((share.path, place, text, why))
            size += len(text or "")
            if len(rows) >= 10_000 or size > 16 << 20:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], SCHEMA.types[k]) for k in range(4)], schema=SCHEMA)


class BoundedRecords(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "bounded_records"

    def schema(self) -> str:
        return "path string, place long, text string, refusal string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))
