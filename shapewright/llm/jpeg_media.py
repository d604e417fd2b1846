"""Baseline JPEG columns: dimensions, DC-only luminance thumbnails, hashes.

``thumbnails`` parses the markers of many images and Huffman-decodes their
scans together: every restart interval is a lane, and all lanes of like tables
take a step at a time in numpy. Only the DC coefficient of each luminance block
is kept, which is the block's mean; AC codes are read to be passed over.

``stored`` writes bytes losslessly as such an image: each byte is the mean of
an 8 x 8 block, 64 blocks a row and a restart interval a row, so that the
thumbnail is the bytes again. Over 8191 rows a further image follows.

Texts: null counts as empty, and an empty text is 64 bytes 0. Very long texts
make more images. Equal texts have equal values. A damaged image in
``media_columns`` has nulls for its columns; a null one too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ACROSS = 64
MOST_ROWS = 8191
#: Bytes of images that are decoded together.
TOGETHER = 4 << 20

#: Our own tables: DC categories 0 to 8 in four bits each; AC's end of block in one.
DC_TABLE = bytes([0, 0, 0, 9, *[0] * 12, *range(9)])
AC_TABLE = bytes([1, *[0] * 15, 0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, bytes([0, 8, *[1] * 63])),
            _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * rows, 8 * ACROSS, 1, 1, 0x11, 0)),
            _segment(0xC4, bytes([0x00]) + DC_TABLE),
            _segment(0xC4, bytes([0x10]) + AC_TABLE),
            _segment(0xDD, struct.pack(">H", ACROSS)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _image(samples: np.ndarray) -> bytes:
    """One image of ``samples`` (rows x 64, unsigned bytes)."""
    rows = len(samples)
    levels = samples.astype(np.int64) - 128
    steps = np.diff(levels, axis=1, prepend=0)
    size = np.abs(steps)
    category = np.frexp(size)[1].astype(np.int64)
    extra = np.where(steps < 0, steps + (1 << category) - 1, steps)
    length = category + 5
    code = (category << (category + 1)) | (extra << 1)  # four bits, the extra bits, end of block
    ends = np.cumsum(length, axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    starts = np.cumsum(row_bytes) - row_bytes
    at = (ends - length) + 8 * starts[:, None]
    word = (code << (24 - (at & 7) - length)).ravel()
    byte = (at >> 3).ravel()
    total = int(row_bytes.sum())
    packed = sum(np.bincount(byte + k, (word >> (16 - 8 * k)) & 255, total + 3) for k in range(3))[:total]
    packed[starts + row_bytes - 1] += (1 << (8 * row_bytes - ends[:, -1])) - 1  # ones up to the byte's end
    packed = packed.astype(np.uint8)
    full = packed == 255
    row_of = np.repeat(np.arange(rows), row_bytes)
    place = np.arange(total) + np.cumsum(full) - full + 2 * row_of
    out = np.zeros(total + int(full.sum()) + 2 * (rows - 1), np.uint8)
    out[place] = packed
    marks = place[starts[1:]] - 2
    out[marks] = 255
    out[marks + 1] = 0xD0 + np.arange(rows - 1) % 8
    return _head(rows) + out.tobytes() + b"\xff\xd9"


def stored(payload: bytes) -> bytes:
    """``payload``, a positive multiple of 64 bytes, as one image or several."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ACROSS)
    return b"".join(_image(samples[k : k + MOST_ROWS]) for k in range(0, len(samples), MOST_ROWS))


@dataclass
class Part:
    """A component in a scan: its number, blocks of a unit, tables."""

    component: int
    blocks: int
    dc: bytes
    ac: bytes


@dataclass
class Picture:
    """What the markers of one image tell, and its scans' restart intervals."""

    width: int = 0
    height: int = 0
    components: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    quantised: dict[int, int] = field(default_factory=dict)
    scans: list[tuple[list[Part], int, list[bytes]]] = field(default_factory=list)
    end: int = 0


def parsed(data: bytes, at: int = 0) -> Picture:
    """Parses one image that begins at ``at``; ValueError if it isn't a baseline one."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    picture, tables, interval = Picture(), {}, 0
    while True:
        if at + 2 > len(data) or data[at] != 255:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 255:
            at += 1
            continue
        if marker == 0xD9:
            picture.end = at + 2
            return picture
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                picture.quantised[number] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + count]
                body = body[17 + count :]
        elif marker == 0xC0:
            bits, picture.height, picture.width, count = struct.unpack_from(">BHHB", body)
            if bits != 8 or not picture.height or not picture.width:
                raise ValueError("not of 8 bits, or without size")
            for k in range(count):
                name, factors, quant = body[6 + 3 * k : 9 + 3 * k]
                if not (1 <= factors >> 4 <= 4 and 1 <= factors & 15 <= 4):
                    raise ValueError("a sampling factor that isn't 1 to 4")
                picture.components[name] = (factors >> 4, factors & 15, quant)
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body[:2])
        elif marker == 0xDA:
            alone = body[0] == 1
            parts = []
            for k in range(body[0]):
                name, which = body[1 + 2 * k : 3 + 2 * k]
                across, down, _ = picture.components[name]
                parts.append(Part(name, 1 if alone else across * down, tables[which >> 4], tables[0x10 | which & 15]))
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("a scan without end")
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            picture.scans.append((parts, interval, _intervals(data[at:end])))
            at = end


def _intervals(scan: bytes) -> list[bytes]:
    """The restart intervals of a scan, without stuffed bytes and markers."""
    raw = np.frombuffer(scan, np.uint8)
    after = np.flatnonzero(raw[:-1] == 255) + 1
    marks = after[raw[after] >= 0xD0]
    cuts = [0, *(marks + 1).tolist()], [*(marks - 1).tolist(), len(scan)]
    return [scan[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(*cuts, strict=True)]


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: the code's length times 256, plus its symbol."""
    if table not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        ahead = np.zeros(1 << 16, np.int32)
        code = first = 0
        for length, count in enumerate(table[:16], 1):
            for symbol in table[16 + first : 16 + first + count]:
                ahead[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
                code += 1
            first += count
            code <<= 1
        _LOOKUPS[table] = ahead
    return _LOOKUPS[table]


def _lanes(parts: list[Part], segments: list[bytes], units: np.ndarray, wanted: int) -> np.ndarray:
    """DC values of component ``wanted`` (lanes x blocks), all lanes in step."""
    joined = np.frombuffer(b"".join(s + b"\xff\xff\xff\xff" for s in segments) + b"\xff" * 64, np.uint8)
    words = joined[:-3].astype(np.uint32) << 24
    for k, shift in ((1, 16), (2, 8), (3, 0)):
        words |= joined[k : len(joined) - 3 + k].astype(np.uint32) << shift
    words = words.astype(np.int64)
    top = len(words) * 8 - 8
    sizes = np.array([len(s) + 4 for s in segments], np.int64)
    at = (np.cumsum(sizes) - sizes) * 8
    blocks = next(p.blocks for p in parts if p.component == wanted)
    values = np.zeros((int(units.max()) * blocks, len(segments)), np.int32)
    before = {p.component: np.zeros(len(segments), np.int64) for p in parts}

    def ahead(where: np.ndarray) -> np.ndarray:
        where = np.minimum(where, top)
        return words[where >> 3] >> (16 - (where & 7)) & 0xFFFF

    for unit in range(int(units.max())):
        live = np.flatnonzero(units > unit)
        pos = at[live]
        for part in parts:
            dc, ac = _lookup(part.dc), _lookup(part.ac)
            for block in range(part.blocks):
                found = dc[ahead(pos)]
                if not found.all():
                    raise ValueError("a code that no table has")
                pos = pos + (found >> 8)
                category = (found & 255).astype(np.int64)
                bits = ahead(pos) >> (16 - category)
                pos = pos + category
                step = np.where(bits < (1 << category) >> 1, bits - (1 << category) + 1, bits)
                last = before[part.component]
                last[live] += step
                if part.component == wanted:
                    values[unit * blocks + block, live] = last[live]
                place = np.ones(len(pos), np.int64)
                open_ = np.arange(len(pos))
                while len(open_):
                    found = ac[ahead(pos[open_])]
                    if not found.all():
                        raise ValueError("a code that no table has")
                    symbol = found & 255
                    pos[open_] += (found >> 8) + (symbol & 15)
                    place[open_] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
                    open_ = open_[place[open_] < 64]
        at[live] = pos
    return values.T


def thumbnails(pictures: list[Picture]) -> list[np.ndarray | None]:
    """The luminance thumbnail of each image, a pixel a block; None if damaged."""
    alike: dict[tuple, list[tuple[int, bytes, int]]] = defaultdict(list)
    shapes: dict[int, tuple[int, int, int, int]] = {}
    damaged: set[int] = set()
    for k, picture in enumerate(pictures):
        luma = next(iter(picture.components), None)
        scan = next(((p, i, s) for p, i, s in picture.scans if any(x.component == luma for x in p)), None)
        if scan is None or picture.components[luma][2] not in picture.quantised:
            damaged.add(k)
            continue
        parts, interval, segments = scan
        across, down, _ = picture.components[luma]
        most = [max(c[i] for c in picture.components.values()) for i in (0, 1)]
        if len(parts) == 1:  # a scan of its own has only the blocks that the picture has
            wide = -(-(-(-picture.width * across // most[0])) // 8)
            high = -(-(-(-picture.height * down // most[1])) // 8)
            across = down = 1
        else:
            wide, high = -(-picture.width // (8 * most[0])), -(-picture.height // (8 * most[1]))
        shapes[k] = wide, high, across, down
        interval = interval or wide * high
        if len(segments) != -(-wide * high // interval):
            damaged.add(k)
            continue
        # a block takes two bits at least: no more is laid out than what is there can fill
        per_unit = sum(p.blocks for p in parts)
        if any(2 * per_unit * min(interval, wide * high - j * interval) > 8 * len(s) for j, s in enumerate(segments)):
            damaged.add(k)
            continue
        key = tuple((p.component == luma, p.blocks, p.dc, p.ac) for p in parts)
        alike[key] += [(k, s, min(interval, wide * high - j * interval)) for j, s in enumerate(segments)]
    values: dict[int, list[np.ndarray]] = defaultdict(list)
    for key, lanes in alike.items():
        parts = [Part(0 if mine else 1 + n, blocks, dc, ac) for n, (mine, blocks, dc, ac) in enumerate(key)]
        per_unit = next(p.blocks for p in parts if p.component == 0)
        units = np.array([n for _, _, n in lanes], np.int64)
        try:
            got = _lanes(parts, [s for _, s, _ in lanes], units, 0)
        except ValueError:
            if len({k for k, _, _ in lanes}) == 1:
                damaged.add(lanes[0][0])
                continue
            for k in {k for k, _, _ in lanes}:  # one of them is damaged: each alone
                mine = [(s, n) for j, s, n in lanes if j == k]
                try:
                    alone = _lanes(parts, [s for s, _ in mine], np.array([n for _, n in mine], np.int64), 0)
                    values[k] = [row[: n * per_unit] for row, (_, n) in zip(alone, mine, strict=True)]
                except ValueError:
                    damaged.add(k)
            continue
        for (k, _, n), row in zip(lanes, got, strict=True):
            values[k].append(row[: n * per_unit])
    out: list[np.ndarray | None] = []
    for k, picture in enumerate(pictures):
        if k in damaged:
            out.append(None)
            continue
        wide, high, across, down = shapes[k]
        luma = next(iter(picture.components))
        levels = np.concatenate(values[k]).reshape(high, wide, down, across).swapaxes(1, 2).reshape(high * down, wide * across)
        levels = np.rint(levels * picture.quantised[picture.components[luma][2]] / 8) + 128
        most = [max(c[i] for c in picture.components.values()) for i in (0, 1)]
        sizes = [-(-(-(-n * f // m)) // 8) for n, f, m in ((picture.height, picture.components[luma][1], most[1]), (picture.width, picture.components[luma][0], most[0]))]
        out.append(np.clip(levels, 0, 255).astype(np.uint8)[: sizes[0], : sizes[1]])
    return out


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits in hexadecimal: whether the mean of each of 8 x 9 cells, which
    take in all pixels, is below that of the next."""
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    sums[1:, 1:] = pixels.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    (top, bottom), (left, right) = ((k * n // many, np.maximum((k + 1) * n // many, k * n // many + 1)) for n, many in ((pixels.shape[0], 8), (pixels.shape[1], 9)) for k in (np.arange(many),))
    whole = sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]
    means = whole / np.outer(bottom - top, right - left)
    return np.packbits(means[:, :-1] < means[:, 1:]).tobytes().hex()


def _pictures(media: bytes) -> list[Picture]:
    found, at = [], 0
    while at < len(media):
        found.append(parsed(media, at))
        at = found[-1].end
    return found


def _read_back(media: list[bytes]) -> list[tuple[bytes, str]]:
    """The payload and the feature of each stored form."""
    pictures = [_pictures(m) for m in media]
    pixels = iter(thumbnails([p for own in pictures for p in own]))
    out = []
    for own in pictures:
        mine = [next(pixels) for _ in own]
        feature = ";".join(f"{p.width}x{p.height}:{thumbnail_hash(t)}" for p, t in zip(own, mine, strict=True))
        out.append((b"".join(t.tobytes() for t in mine), feature))
    return out


def text_media(docs: DataFrame) -> DataFrame:
    """Stores each text as JPEG, reads the stored bytes back and describes them."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def rows(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        media = [stored(t + bytes(-len(t) % 64 or 64 * (not t))) for t in texts]
        out = []
        for doc_id, text, own, (payload, feature) in zip(ids, texts, media, _read_back(media), strict=True):
            out.append((doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(own), hashlib.sha256(own).hexdigest(), feature))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append((text.as_py() or "").encode())
                held += len(texts[-1])
                if held > TOGETHER // 4:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield rows(ids, texts)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def media_columns(images: DataFrame) -> DataFrame:
    """(image_id, width, height, thumbnail, thumbnail_hash) of a table of images
    (image_id long, jpeg binary); the last four are null where an image is null
    or damaged."""

    def described(values: list[bytes | None]) -> list[tuple]:
        pictures: list[Picture | None] = []
        for value in values:
            try:
                pictures.append(parsed(value) if value else None)
            except (ValueError, KeyError, IndexError, struct.error):
                pictures.append(None)
        pixels = iter(thumbnails([p for p in pictures if p]))
        out = []
        for p in pictures:
            small = next(pixels) if p else None
            out.append((None,) * 4 if small is None else (p.width, p.height, small.tobytes(), thumbnail_hash(small)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = zip(*described(part.column(1).to_pylist()), strict=True)
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["image_id", "width", "height", "thumbnail", "thumbnail_hash"])

    return images.select("image_id", "jpeg").mapInArrow(run, "image_id long, width int, height int, thumbnail binary, thumbnail_hash string")
