"""Columns of the operators held against plain Python that shares no code with them."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import DOCS, LONG, texts

from conftest import SMALL
from shapewright.llm import hilbert, jpeg_media, licenses, line_dedup, mixture, near_copies, ngram_rules, quality_net, queries, simhash
from shapewright.llm.common import forget, reach_workers, settle, settled_paths, shared_folder, table


def own_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    own = texts(spark)
    got = {r.doc_id: r.fingerprint for r in queries.op5_simhash(spark, SMALL).collect()}
    short = {i: t for i, t in own.items() if len(t) < 6000}
    assert len(short) > 100 and all(got[i] == f"{own_fingerprint(t):016x}" for i, t in short.items())


@pytest.mark.parametrize("radius", [1, 4, 6, 7, 24])
def test_planes_find_all_pairs_within_a_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 12).tolist()
    fps = np.array([b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 30), replace=False)) for b in base for _ in range(17)], np.uint64)
    group = np.sort(rng.integers(0, 3, len(fps)))
    got = {(int(a), int(b)) for i, j in simhash.close_lanes(fps, group, radius) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if group[a] == group[b] and (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}
    assert got == want and want


def test_vectors_and_pooling_of_a_toy_corpus(spark):
    reach_workers(spark)
    docs = ["a b c a", "b", "", "c a b 漢字 a"]
    got = quality_net.context_sums(spark.createDataFrame([(t,) for t in docs], "text string"))
    places, signs = quality_net.index_vectors()
    split = [["a", "b", "c", "a"], ["b"], [], ["c", "a", "b", "漢", "字", "a"]]
    at = lambda w: zlib.crc32(w.encode()) % quality_net.BUCKETS
    want = np.zeros((quality_net.BUCKETS, quality_net.PLACES), np.int64)
    for words in split:
        for i, w in enumerate(words):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    for k in range(quality_net.NONZERO):
                        want[at(w), places[at(words[j]), k]] += signs[at(words[j]), k]
    assert (got == want).all()
    units = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1)
    each = np.array([units[at(w)] for w in split[3]])
    told = quality_net.pooled(docs[3], units)
    assert told[: quality_net.PLACES] == pytest.approx(each.mean(axis=0)) and told[quality_net.PLACES : -2] == pytest.approx(each.std(axis=0))
    assert told[-1] == pytest.approx(5 / 6)


def test_quality_of_repeated_ids_hangs_on_no_order(spark):
    reach_workers(spark)
    rows = [(k, f"good words here {k}", 0) for k in range(60)] + [(k, f"bad !! spam {k}", 0) for k in range(60)] + [(500, "", 0), (501, None, 0)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    scores = []
    for given in (rows, rows[::-1]):
        got = quality_net.quality_scores(spark.createDataFrame(given, "doc_id long, text string, n long"), labels).collect()
        scores.append(sorted((r.doc_id, r.text or "", r.score) for r in got))
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in got)
    assert [x[:2] for x in scores[0]] == [x[:2] for x in scores[1]] and [x[2] for x in scores[0]] == pytest.approx([x[2] for x in scores[1]], abs=1e-9)
    assert scores[0][-1][2] == scores[0][-2][2]  # null and empty


def own_curve(cell, bits):
    """The place of a cell by walking the curve's recursion: rotate, then count in."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(x[i] >> b & 1) for b in range(bits - 1, -1, -1) for i in range(n)), 2)


def test_shards_are_runs_of_the_curve(spark):
    docs = table(spark, SMALL, "documents").collect()
    got = {r.doc_id: r for r in queries.op4_hilbert_shards(spark, SMALL).collect()}
    low, high = min(d.doc_id for d in docs), max(d.doc_id for d in docs)
    few = lambda v: zlib.crc32((v or "").encode()) % 16
    for d in docs:
        size = len((d.text or "").encode()) + 1
        cell = [min(max(int(math.log2(size)) - 4, 0), 15), few(d.source), few(d.lang), min((d.doc_id - low) * 16 // (high - low + 1), 15)]
        assert got[d.doc_id].curve_index == own_curve(cell, 4) and got[d.doc_id].law == "rows" and got[d.doc_id].grown_shard is None
    along = sorted(got.values(), key=lambda r: (r.shard, r.slot))
    assert [r.curve_index for r in along] == sorted(r.curve_index for r in along)
    # a range of one dimension prunes: shards hold fewer sources' classes than all of them do
    whole = len({few(d.source) for d in docs})
    assert np.mean([len({few(d.source) for d in docs if got[d.doc_id].shard == s}) for s in range(8)]) < whole


def test_media_columns_of_texts(spark):
    reach_workers(spark)
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 33), (5, LONG), (6, LONG), (None, "x")]
    for r in jpeg_media.text_media(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        data = (dict(rows)[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 or 64 * (not data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = jpeg_media.stored(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
        if len(pixels) < 8191:
            cut = lambda n, many, k: slice(k * n // many, max((k + 1) * n // many, k * n // many + 1))
            means = [[pixels[cut(len(pixels), 8, i), cut(64, 9, j)].mean() for j in range(9)] for i in range(8)]
            bits = "".join(str(int(row[j] < row[j + 1])) for row in means for j in range(8))
            assert r.feature == f"512x{8 * len(pixels)}:{int(bits, 2):016x}"


def test_damaged_images_are_nulls(spark):
    reach_workers(spark)
    good = jpeg_media.stored(bytes(range(64)))
    forged = good.replace(bytes([0xFF, 0xC0, 0, 11, 8, 0, 8, 2, 0]), bytes([0xFF, 0xC0, 0, 11, 8, 0xFF, 0xF8, 0xFF, 0xF8]))
    images = {1: good, 2: good.replace(b"\xff\xdb", b"\xff\xe0"), 3: good.replace(bytes([1, 1, 0x11, 0]), bytes([1, 1, 0x01, 0])), 4: forged, 5: None, 6: b"", 7: good[:30]}
    assert forged != good
    got = {r.image_id: r for r in jpeg_media.media_columns(spark.createDataFrame(list(images.items()), "image_id long, jpeg binary")).collect()}
    assert bytes(got[1].thumbnail) == bytes(range(64))
    assert all(got[k].width is None and got[k].thumbnail_hash is None for k in range(2, 8))


def test_log_ratios_and_verdicts(spark):
    words = lambda t: [w for w in (t or "").replace("\n", " ").split(" ") if w]
    docs = [(1, "good plain words " * 8), (2, "spam spam now " * 8), (3, None), (4, "one"), (5, "good words and spam now in one text of twenty words and some more so that none of the rules drops it at once")]
    labels = [(1, 1), (2, 0), (None, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    hashed = {r.w: r.h for r in frame.select(F.explode(ngram_rules.words_of(F.col("text"))).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {(a, b) for _, t in docs for a, b in zip(words(t), words(t)[1:])}
    pair = {(r.a, r.b): r.h for r in spark.createDataFrame([(a, b, hashed[a], hashed[b]) for a, b in pairs], "a string, b string, x long, y long").select("a", "b", F.xxhash64("x", "y").alias("h")).collect()}
    grams = {i: [h % 8192 for h in [hashed[w] for w in words(t)] + [pair[a, b] for a, b in zip(words(t), words(t)[1:])]] for i, t in docs}
    raw, target = collections.Counter(g for gs in grams.values() for g in gs), collections.Counter(grams[1])
    n_raw, n_target = sum(raw.values()) + 8192, sum(target.values()) + 8192
    for r in ngram_rules.quality_rules(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect():
        own = grams[r.doc_id]
        want = sum(math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw) for g in own) / len(own) if own else None
        assert r.log_ratio == (pytest.approx(want, abs=1e-8) if own else None)
        assert r.kept == (not r.base_failed and want is not None and want >= -0.08)
        assert r.n_words == len(words(dict(docs)[r.doc_id]))


def test_mixture_counts_every_row(spark):
    rows = [(1, "a b c", "en", "s", 0), (1, "a b c", "en", "s", 0), (1, "other", "en", "s", 0), (None, "x y", "en", None, 0), (None, "x y", "en", "s", 0), (2, None, "en", "t", 0), (3, "w " * 50, "en", "big", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixture.mixed(docs).collect()
    assert sorted((r.doc_id or 0, r.source, r.n_tokens) for r in got) == sorted((i or 0, s or "", len((t or "").split())) for i, t, _, s, _ in rows)
    assert all(r.epochs >= 1 for r in got)
    tokens = collections.Counter()
    for r in got:
        tokens[r.source] += r.epochs * r.n_tokens
    plain = {"s": 9, "": 2, "big": 50}
    assert all(plain[s] <= tokens[s] <= 2 * plain[s] + 1 for s in plain)
    again = mixture.repeated(docs)
    assert again.count() == sum(r.epochs for r in got) and again.columns == docs.columns
    assert mixture.repeated(docs.limit(0)).count() == 0


def test_mixture_cuts_a_block_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCKS", 2)
    docs = spark.range(400).select((F.col("id") * 7919).alias("doc_id"), F.expr("repeat('w ', cast(id % 5 as int))").alias("text"), F.when(F.col("id") < 350, "large").otherwise("small").alias("source"))
    told = []
    for size in (1 << 40, 1 << 18):
        monkeypatch.setattr(mixture, "RANGE", size)
        told.append(sorted((r.doc_id, r.epochs) for r in mixture.mixed(docs).collect()))
    assert told[0] == told[1] and len({e for _, e in told[0]}) > 1


def test_licences_of_whole_sentences(spark):
    gpl1 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    rows = {
        1: gpl1.replace("/or modify", "/or\n * modify"),
        2: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If a copy",
        3: " * " + "\n * ".join(["Copyright x", ""] + [licenses.SENTENCES["mit-grant"].replace("copy of this", "copy of\n * this"), "", licenses.SENTENCES["mit-notice"], "", licenses.SENTENCES["as-is"]]),
        4: "\n".join(licenses.SENTENCES[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names")),
        5: "\n".join(licenses.SENTENCES[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary")),
        6: "Released under the MIT License.", 7: None, 8: "", 9: "licensed", 10: "Released under the MIT License.",
    }
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("licenses", F.lit(1))).collect()}
    told = {k: {x.split("/")[0] for x in r.licenses} for k, r in got.items()}
    assert told == {1: {"gpl-1.0-or-later"}, 2: {"mpl-1.1"}, 3: {"mit"}, 4: {"bsd-3-clause"}, 5: {"bsd-2-clause"}, 6: {"mit"}, 7: set(), 8: set(), 9: set(), 10: {"mit"}}
    assert got[6] != got[7] and [(p.id, p.place) for p in got[6].sentence_places] == [("released-under-the-mit-license", 1)]
    mine = licenses.license_scan(spark.createDataFrame([(1, "One. Two. Three.")], "doc_id long, text string"), {"ab": "One. Two.", "c": "Three."}, {"x": ["ab", "c"], "y": ["c", "ab"]}).first()
    assert mine.sentence_ids == ["ab", "c"] and mine.licenses == ["x"]


def test_lines_of_odd_rows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\ne"), (3, None), (4, ""), (None, "a\nb\nc"), (5, "a\nb"), (6, "q\nq\nq\nq"), (7, "a\nb\nc")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("a\nb\nc\nd", 4, 0), 2: ("e", 4, 3), 3: (None, None, None), 4: ("", 1, 0), None: ("a\nb\nc", 3, 0), 5: ("a\nb", 2, 0), 6: ("q", 4, 3), 7: ("", 3, 3)}


def test_shards_of_odd_rows(spark):
    rows = [(1, None, None, None, 0), (None, "x", "en", "a", 0), (2, "x", "en", "a", 0), (2, "x", "en", "a", 0)]
    got = hilbert.hilbert_shards(spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == [(0, 2, zlib.crc32(b"x")), (1, 1, 0), (2, 2, zlib.crc32(b"x")), (2, 2, zlib.crc32(b"x"))]
    assert len({(r.shard, r.slot) for r in got}) == 4


def test_settled_tables_are_removed(spark):
    before = len(settled_paths())
    made = settle(spark.range(3))
    assert made.count() == 3 and len(settled_paths()) == before + 1 and settled_paths()[-1].startswith(shared_folder(spark))
    forget(spark, settled_paths()[-1:])
    assert len(settled_paths()) == before
    with pytest.raises(Exception, match="exist|FILE_NOT|PATH"):
        spark.read.parquet(made.inputFiles()[0]).count()


def test_recall_of_near_copies_at_sf001(spark):
    """Pairs of one changed word in texts of the corpus: all of a similarity of 0.8 are met."""
    reach_workers(spark)
    docs = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").distinct().collect() if r.text and len(r.text.split()) > 150][:150]
    rows = []
    for k, t in enumerate(docs):
        w = t.split()
        w[len(w) // 2] = "changedword"
        rows += [(2 * k, t), (2 * k + 1, " ".join(w))]
    found = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")["component"]
    shingled = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)}
    pairs = [(shingled(rows[2 * k][1]), shingled(rows[2 * k + 1][1]), found[2 * k] == found[2 * k + 1]) for k in range(len(docs))]
    alike = [met for a, b, met in pairs if len(a & b) >= 0.8 * len(a | b)]
    assert len(alike) > 100 and all(alike)
