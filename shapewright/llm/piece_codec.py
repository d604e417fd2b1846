"""SentencePiece encoding and decoding by a table of last tokens.

For every prefix of a run of characters exactly one token can be the last one
of its byte-pair encoding. The table holds that token; candidates are the
pieces that an Aho-Corasick automaton finds to end at the position, and a
candidate is right if it is compatible with the last token of the prefix before
it: the merges over both tokens' characters give back just these two. The ids
are then read off the table from its end.

No piece runs from a letter into a space mark, so the text falls into segments
(space marks and what follows them) that are encoded apart and remembered.

Texts: null counts as empty; an empty text has only the begin and end ids.
Repeated texts give equal rows. Columns of the input other than the id and the
text are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
#: Entries that a worker remembers of segments, and of pairs of tokens.
REMEMBERED = 600_000
#: Characters of a segment that is remembered, at most, so that a worker's memory is bounded in bytes.
LONGEST = 64
#: Rows whose ids and decoded texts stand in memory at a time.
AT_ONCE = 1024


class Segments(dict):
    """Bytes of ids and bytes of decoded text of each segment met so far."""

    def __init__(self, codec: PieceCodec, lead: str):
        self.codec, self.lead = codec, lead

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        ids = self.codec.segment_ids(self.lead + word)
        got = (struct.pack(f"<{len(ids)}I", *ids), self.codec.bytes_of(ids))
        if len(word) <= LONGEST:  # a text without spaces is one segment
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = got
        return got


class PieceCodec:
    """Encoder and decoder for one model file of the BPE kind with byte fallback."""

    def __init__(self, model_path: str):
        model = SentencePieceProcessor(model_file=model_path)
        probe = "ﬁ  Å "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError(f"{model_path} normalises texts; only models that leave them as they are can be read")
        size = range(model.vocab_size())
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in size if model.is_byte(i)}
        plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        #: Pieces merge in the order of their scores; equal scores from left to right.
        self.order = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError(f"{model_path} has pieces that run into the next word")
        self.texts = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.known = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple[list[str], list[str]] | None] = {}
        self.words, self.segments = Segments(self, MARK), Segments(self, "")

    def merged(self, run: str) -> list[str]:
        """The encoding of a short run by merging pairs one by one."""
        parts, order = list(run), self.order
        while len(parts) > 1:
            best, at = min((order.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, piece: str) -> tuple[list[str], list[str]] | None:
        """The parts at the left and at the right edge of a piece, from its
        character to the whole; None if merging its characters doesn't give it."""
        if piece not in self.edges:
            parts, halves = list(piece), {}
            while len(parts) > 1:
                best, at = min((self.order.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == float("inf"):
                    break
                halves[parts[at] + parts[at + 1]] = parts[at], parts[at + 1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            sides: list[list[str]] = [[piece], [piece]]
            for side in (0, 1):
                while (part := sides[side][-1]) in halves:
                    sides[side].append(halves[part][side])
            self.edges[piece] = None if len(parts) > 1 else (sides[0][::-1], sides[1][::-1])
        return self.edges[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether these two tokens can stand side by side; left may be empty.

        At the seam, the next merge is that within the left token, that within
        the right one or that across, whichever scores best; one across says no.
        """
        ours, theirs = self.spines(left) if left else ([], [""]), self.spines(right)
        if theirs is None or ours is None:
            return False
        if not left:
            return True
        if right[-1] == MARK:  # pieces of marks share a score: what merges first hangs on places
            return self.merged(left + right) == [left, right]
        order, far = self.order, float("inf")
        a, b = ours[1], theirs[0]
        i = j = 0
        ends = len(a) - 1, len(b) - 1
        while True:
            in_left = order[a[i + 1]] if i < ends[0] else far
            in_right = order[b[j + 1]] if j < ends[1] else far
            across = order.get(a[i] + b[j], far)
            if across < in_left and across <= in_right:
                return False
            if in_left == in_right == far:
                return True
            if in_left <= in_right:
                i += 1
            else:
                j += 1

    def run_tokens(self, run: str) -> list[str]:
        """The tokens of a run of known characters, by the table of last tokens."""
        last, pairs, settled = [""], self.pairs, 0
        for at, (piece, length) in self.automaton.iter(run):  # at each place the longest piece comes first
            if at < settled:
                continue
            pair = last[at + 1 - length], piece
            fits = pairs.get(pair)
            if fits is None:
                if len(pairs) >= REMEMBERED:
                    pairs.clear()
                fits = pairs[pair] = self.compatible(*pair)
            if fits:
                last.append(piece)
                settled = at + 1
        tokens, at = [], len(run)
        while at:
            tokens.append(last[at])
            at -= len(last[at])
        return tokens[::-1]

    def segment_ids(self, segment: str) -> list[int]:
        """Ids of one segment; characters without a piece become byte tokens."""
        if self.known.issuperset(segment):
            return [self.ids[t] for t in self.run_tokens(segment)]
        ids: list[int] = []
        at = 0
        while at < len(segment):
            end = at
            while end < len(segment) and segment[end] in self.known:
                end += 1
            if end > at:
                ids += [self.ids[t] for t in self.run_tokens(segment[at:end])]
            else:
                end = at + 1
                ids += [self.byte_ids[b] for b in segment[at].encode()]
            at = end
        return ids

    def bytes_of(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for; begin, end and unknown ids stand for none."""
        return b"".join([self.texts.get(i, b"") for i in ids])

    def coded(self, text: str) -> tuple[bytes, str]:
        """The ids of a text, as little-endian unsigned 32-bit integers with the
        begin and end ids, and the text that they decode to."""
        words = text.split(" ")
        if not text:
            parts = []
        elif MARK in text or "" in words:
            parts = [self.segments[s] for s in SEGMENT.findall(MARK + text.replace(" ", MARK))]
        else:
            parts = [self.words[w] for w in words]
        begin, end = (i.to_bytes(4, "little") for i in (self.begin, self.end))
        decoded = b"".join([p[1] for p in parts])[1:]  # without the mark put before the text
        return b"".join([begin, *[p[0] for p in parts], end]), decoded.decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        data = self.coded(text)[0]
        return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]

    def decode(self, ids: list[int]) -> str:
        data = self.bytes_of(ids)
        return data.removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The worker's codec for a model, built when first asked for."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def encode_texts(docs: DataFrame, model_path: str, *, with_ids: bool = True) -> DataFrame:
    """Encode and decode every text of ``docs``.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless
    ``with_ids`` is false, ids (array of int) and decoded. The work needs no
    shuffle; a task holds one Arrow batch, the results of AT_ONCE of its rows
    and a bounded memory of segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            coded = [own.coded(value.as_py() or "") for value in batch.column(1)]
            sizes = np.array([len(ids) // 4 for ids, _ in coded], np.int64)
            out = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array(sizes),
                "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in coded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(decoded.encode()).hexdigest() for _, decoded in coded], pa.string()),
            }
            if with_ids:
                places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(b"".join([ids for ids, _ in coded]), "<u4").astype(np.int32)))
                out["decoded"] = pa.array([decoded for _, decoded in coded], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
