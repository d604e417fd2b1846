import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from oracle import same
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from shapewright.llm import components, hilbert, jpeg_media, licenses, line_dedup, mixture, ngram_rules, piece_codec, quality_net, queries, simhash, suffix_dedup
from shapewright.llm.common import reach_workers, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977} of{k % 31}" for k in range(6000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    reach_workers(spark)
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, LONG, "en", None, None), (3, LONG, "en", None, None), (4, "a\nb\nc\nd", "en", "b", 7), (5, "a\nb\nc\ne", "en", "b", 7), (6, " \t\n", "fr", "b", 3), (None, "no id here", "en", "b", 1), (7, "a\nb\nc\nd", "en", "c", 7), (8, "x▁y  é漢 \x00 𐍈", "en", "c", 9)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("hashes", F.lit(1)).withColumn("rank", F.lit(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(1, 9)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "licenses": lambda d, l: licenses.license_scan(d),
    "codec": lambda d, l: piece_codec.encode_texts(d, MODEL, with_ids=True),
    "quality": quality_net.quality_scores,
    "shards": lambda d, l: hilbert.hilbert_shards(d),
    "simhash": lambda d, l: simhash.near_duplicates(d),
    "mixture": lambda d, l: mixture.repeated(d),
    "suffixes": lambda d, l: suffix_dedup.without_repeats(d),
    "lines": lambda d, l: line_dedup.without_repeated_lines(d),
    "media": lambda d, l: jpeg_media.text_media(d),
    "rules": ngram_rules.quality_rules,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_and_empty_tables(spark, odd, none, labels, name):
    got = OPERATORS[name](odd, labels).collect()
    assert len(got) >= odd.count()
    assert OPERATORS[name](none, labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], SMALL)


def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}


def test_codec_is_exact(spark):
    model, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.PieceCodec(MODEL)
    rng = random.Random(5)
    odd = ["a", "é", "▁", " ", "   ", "\n", "漢", "𐍈", "\x00", "<s>", "<0x0A>", "the", "==", " ", "ﬁ", "か"]
    some = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [c * n for c in " \n=a" for n in range(70)]
    for t in some + list(texts(spark).values()):
        ids = model.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == ids
        assert own.coded(t)[1] == own.decode(ids) == model.decode(ids)


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_quality_net(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_hilbert_curve(spark):
    for n, b in ((2, 3), (3, 2), (4, 2)):
        cells = spark.range(1 << n * b).select(F.array(*[F.shiftright("id", b * k).bitwiseAND((1 << b) - 1).cast("int") for k in range(n)]).alias("a"))
        rows = sorted(cells.select(hilbert._curve_index(F.col("a"), n, b).alias("i"), "a").collect())
        assert [r.i for r in rows] == list(range(1 << n * b))
        assert all(sum(abs(p - q) for p, q in zip(u.a, v.a, strict=True)) == 1 for u, v in zip(rows, rows[1:], strict=False))


def test_shards(spark):
    got = queries.op4_hilbert_shards(spark, SMALL).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert set(got["shard"]) == set(range(8)) and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    own = texts(spark)
    assert all(r.size == len(own[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(own[r.doc_id].encode()) for r in got[["doc_id", "size", "text_crc32"]].itertuples() if (len(own[r.doc_id].encode()) + 1 == r[2]))
    assert all(r[2] == len(own[r[1]].encode()) + 1 and r[3] == zlib.crc32(own[r[1]].encode()) for r in got[["doc_id", "size", "text_crc32"]].itertuples())


def test_simhash_equals_brute_force(spark):
    got = queries.op5_simhash(spark, SMALL).toPandas().sort_values("doc_id")
    own = texts(spark)
    fps = [simhash.fingerprint(own[i]) for i in got.doc_id]
    assert [f"{f:016x}" for f in fps] == got.fingerprint.tolist()
    parent = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i + 1, len(fps)):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = (_root(parent, x) for x in (i, j))
                parent[max(a, b)] = min(a, b)
    ids = got.doc_id.tolist()
    assert [ids[_root(parent, k)] for k in range(len(ids))] == got.component_id.tolist()


def _root(parent, a):
    while parent[a] != a:
        a = parent[a]
    return a


def test_crowded_groups_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 8)
    fps = np.unique([b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (40, 2))])
    nodes = spark.createDataFrame([(int(k), int(f)) for k, f in enumerate(fps)], "name long, fp long")
    want = _components(fps)
    for largest in (8, 4096):
        links = simhash.fingerprint_links(nodes, largest=largest)
        got = {r.node: r.component for r in components.components(links).collect()}
        assert [got.get(k, k) for k in range(len(fps))] == want


def _components(fps):
    parent = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = _root(parent, i), _root(parent, j)
                parent[max(a, b)] = min(a, b)
    return [_root(parent, k) for k in range(len(fps))]


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert set(got.values()) == {0, 1000} and got[60] == 0 and got[1099] == 1000


def removed(rows):
    seen = collections.Counter(b[s : s + 400] for _, t in rows for b in [(t or "").encode()] for s in range(len(b) - 399))
    out = collections.defaultdict(list)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        runs = sum(1 for x in range(len(b)) if gone[x] and (not x or not gone[x - 1]))
        out[i].append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("largest", [2, 1024])
def test_suffixes_equal_brute_force(spark, monkeypatch, largest):
    monkeypatch.setattr(suffix_dedup, "LARGEST", largest)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh ") for _ in range(7)) for _ in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    rows = [(k, (base := " ".join(rng.choice(words) for _ in range(60))) + passage[rng.randint(0, 200) : rng.randint(430, len(passage))] + base[:100]) for k in range(40)]
    rows += [(100, "ab" * 700), (101, "x" * 1200), (102, "x" * 399), (103, "x" * 400), (104, None), (105, ""), (106, "é" * 300), (100, "ab" * 700), (None, passage[5:450])]
    got = collections.defaultdict(list)
    for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect():
        got[r[0]].append(tuple(r[1:]))
    want = removed(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_media_round_trip(spark):
    payloads = [t.encode() for t in ["", "a", "ÿ" * 70, LONG]] + [bytes(range(256)) * 3]
    payloads = [p + bytes(-len(p) % 64 or 64 * (not p)) for p in payloads]
    assert [p for p, _ in jpeg_media._read_back([jpeg_media.stored(p) for p in payloads])] == payloads
    images = spark.createDataFrame([(1, jpeg_media.stored(payloads[0])), (2, b"no image"), (3, None), (4, jpeg_media.stored(payloads[1])[:-40])], "image_id long, jpeg binary")
    got = {r.image_id: r for r in jpeg_media.media_columns(images).collect()}
    assert (got[1].width, got[1].height) == (512, 8) and bytes(got[1].thumbnail) == payloads[0]
    assert got[2].width is None and got[3].width is None and got[4].width is None


def test_decoder_reads_ac_codes_and_several_components():
    """A picture of 16 x 16 with halved chroma, coded bit by bit here."""
    dc, ac = bytes([0, 2, 1, *[0] * 13, 0, 3, 5]), bytes([0, 2, 0, 1, *[0] * 12, 0, 0x11, 0xF0])
    codes = {0: "00", 3: "01", 5: "100"}, {0: "00", 0x11: "01", 0xF0: "1000"}
    bits = ""
    levels = [5, 0, -5, 17]  # DC steps of the four luminance blocks
    for step in levels:
        size = abs(step).bit_length()
        bits += codes[0][size] if size in codes[0] else ""
        bits += format(step if step > 0 else step + (1 << size) - 1, f"0{size}b") if size else ""
        bits += codes[1][0x11] + "1" + codes[1][0xF0] + codes[1][0]
    bits += 2 * (codes[0][0] + codes[1][0])
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = jpeg_media._segment
    image = b"\xff\xd8" + seg(0xDB, bytes([0, 16, *[1] * 63])) + seg(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (got,) = jpeg_media.thumbnails([jpeg_media.parsed(image)])
    assert got.tolist() == [[138, 138], [128, 162]]


def test_rules_equal_brute_force(spark):
    got = {r.doc_id: r for r in queries.op10_ngram_rules(spark, SMALL).collect()}
    for i, t in texts(spark).items():
        words = t.encode().split()
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        inside = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [v for v in t.split("\n") if v.encode().split()]
        failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
        bare = b"".join(words).decode()
        want = (len(words), len(bare), sum(c in "#*$%&|<>" for c in bare), len(lines) - len(set(lines)), len(inside), failed)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not failed and r.log_ratio is not None and r.log_ratio >= ngram_rules.THRESHOLD)


def test_entropy_target_is_met(spark):
    x = mixture.exponent_of_entropy(spark.createDataFrame([(p,) for p in (0.7, 0.2, 0.1)], "share double"), 1.0)
    p = np.array([0.7, 0.2, 0.1]) ** x
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 1.0) < 1e-6


def test_wrapped_license_text(spark):
    lines = "Licensed under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in compliance\nwith the License. You may obtain a copy of the License at\nthe usual place."
    got = licenses.license_scan(spark.createDataFrame([(1, lines)], "doc_id long, text string")).first()
    assert "apache-2.0/line" not in got.licenses


def test_pipeline(spark):
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, SMALL).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0 < docs.count() <= 2 * before
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = collections.Counter(hashlib.sha256(np.array(model.encode(r.text, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for r in docs.collect())
    assert collections.Counter(got.ids_sha256) == want
