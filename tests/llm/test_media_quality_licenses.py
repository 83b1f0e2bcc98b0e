import hashlib
import random
import re
import struct
import zlib

import numpy as np
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import licenses, media, quality
from tests.llm.cases import PROSE, awkward, clashing, empty


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40_000))
def test_container_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 192 == 0 and payload[: len(raw)] == raw and len(payload) >= 192
    stored = media.write_container(payload)
    (track,) = media.probe_container(stored)
    assert media.read_samples(stored, track) == payload
    n = len(payload) // 192
    assert track["codec"] == "raw " and track["duration"] == track["ticks"] == n and track["handler"] == "vide"
    assert [size for _, size in track["keyframes"]] == [192] * len(range(0, n, media.KEY_EVERY))
    assert all(stored[s : s + 192] == payload[i * media.KEY_EVERY * 192 :][:192] for i, (s, _) in enumerate(track["keyframes"]))


def test_foreign_tables():
    """Variable sizes, several chunks, 64-bit offsets, wide boxes, no sync table: by hand."""
    full = lambda k, body: struct.pack(">I4sI", 12 + len(body), k, 0) + body
    box = lambda k, body: struct.pack(">I4s", 8 + len(body), k) + body
    data = b"aabbbc"
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1) + box(b"avc1", bytes(70))) + full(b"stts", struct.pack(">IIIII", 2, 1, 10, 2, 5)) + full(b"stsc", struct.pack(">I3I3I", 2, 1, 2, 1, 2, 1, 1)) + full(b"stsz", struct.pack(">II3I", 0, 3, 2, 3, 1)) + full(b"co64", struct.pack(">IQQ", 2, 16, 21)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 20, 0, 0)) + full(b"hdlr", bytes(4) + b"vide" + bytes(13)) + box(b"minf", stbl))
    movie = mdat + box(b"moov", box(b"trak", mdia))
    (track,) = media.probe_container(movie)
    assert track["codec"] == "avc1" and track["ticks"] == 20 and track["offsets"] == [16, 18, 21]
    assert track["keyframes"] == [(16, 2), (18, 3), (21, 1)] and media.read_samples(movie, track) == data
    assert media.probe_container(b"") == [] and media.probe_container(movie[:40]) == [] and media.probe_container(b"\xff" * 64) == []


def test_media_operator(spark):
    docs = clashing(awkward(spark))
    rows = media.media_digest(media.store_texts(docs)).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), hashlib.sha256(media.padded((r.text or "").encode())).hexdigest(), zlib.crc32(media.padded((r.text or "").encode())[-16:])) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id == 7}) == 1
    probed = media.probe_media(media.store_texts(docs)).collect()
    assert all(r.codec == "raw " and r.n_samples >= 1 and r.keyframes[0].size == 192 for r in probed)
    assert media.media_digest(media.store_texts(empty(spark))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, b"junk")], "id int, media binary")
    assert [(r.codec, r.n_samples, r.keyframes) for r in media.probe_media(odd).collect()] == [(None, 0, [])] * 2


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    raw = text.encode()
    good = False
    if raw:
        c = zstandard.ZstdCompressor(level=3)
        ratio = len(raw) / len(c.compress(raw))
        low, high = next((a, b) for n, a, b in quality.BANDS if len(raw) <= n)
        full = [raw[i : i + 1024] for i in range(0, len(raw) - 1023, 1024)] + ([raw[-1024:]] if len(raw) > 1024 and len(raw) % 1024 else [])
        odd = sum(not 1.3 <= 1024 / len(c.compress(x)) <= 2.25 for x in full)
        good = low <= ratio <= high and odd <= 0.1 * len(full)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed, good and not failed


def test_a_bad_tail_is_seen():
    """Repeated or random bytes after the last whole chunk are part of the last chunk."""
    rng = random.Random(3)
    good = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(700))[: 4 * 1024].encode()
    compress = zstandard.ZstdCompressor(level=3).compress
    bands = ((float("inf"), 0.5, 5.0),)
    assert quality.band_verdict(good, compress, bands)[1:] == (0.0, True)
    for tail in (b"ab " * 300, bytes(rng.randrange(33, 256) for _ in range(900))):
        assert quality.band_verdict(good + tail, compress, bands)[1:] == (0.2, False)


def test_quality_against_brute_force(spark):
    docs = clashing(awkward(spark)).unionByName(clashing(spark.createDataFrame([(20, "a b c\n" * 30 + "x\n\nx\na b c", "", "", 0), (21, "spam " * 500, "", "", 0), (22, PROSE + " # * $", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")))
    got = sorted(map(str, (tuple(r)[:8] for r in quality.judge_quality(docs).collect())))
    assert got == sorted(str((r.doc_id, *brute_quality(r.text))) for r in docs.collect())
    assert quality.judge_quality(empty(spark)).count() == 0
    kept = sorted(str(r.doc_id) for r in quality.keep_good(docs).collect())
    assert kept == sorted(str(r.doc_id) for r in docs.collect() if brute_quality(r.text)[-1])
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_keeps_labelled_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").dropDuplicates(["doc_id"])
    rows = quality.judge_quality(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.7 * len(bad)


def brute_license(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_base_against_brute_force(spark):
    more = spark.createDataFrame([(30, "MIT-License, mit license; GNU General Public License cc by CC by", "", "", 0), (31, "summit license permit licenses", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = clashing(awkward(spark)).unionByName(clashing(more))
    got = licenses.scan_licenses(docs).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(str((r.doc_id, *brute_license(r.text))) for r in docs.collect())
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_license_spans(spark):
    text = licenses.TEMPLATES["bsd"].split()
    edited = " ".join(w for i, w in enumerate(text) if i not in (20, 41))
    rows = [(1, PROSE + edited + " " + PROSE, "", "", 0), (2, PROSE + " ".join(text[:12]) + PROSE, "", "", 0), (3, PROSE, "", "", 0), (4, "so: " + licenses.TEMPLATES["mit-text"] + " and " + licenses.TEMPLATES["isc"], "", "", 0)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[1].labels == "bsd" and got[1].n_spans == 1 and 0.8 < got[1].score < 1
    assert got[2].labels == got[3].labels == "" and got[2].score == got[3].score == 0
    assert set(got[4].labels.split(",")) >= {"mit", "isc"} and got[4].score == 1


def test_license_lines_one_after_the_other(spark):
    lines = {"cc-by-nc-4.0": licenses.TEMPLATES["cc-by-nc-4.0-line"], "apache-2.0": licenses.TEMPLATES["apache-2.0-line"]}
    rows = [(10 * i + n, " ".join([line] * n)) for i, line in enumerate(lines.values()) for n in (1, 2, 3, 9)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(lines):
        for n in (1, 2, 3, 9):
            assert label in got[10 * i + n].labels.split(",") and got[10 * i + n].n_spans == n and got[10 * i + n].score == 1


def test_license_labels_tell_licenses_and_versions_apart(spark):
    notice = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    gpl = "This work is licensed under the GNU {}General Public License, version {}."
    longer = licenses.TEMPLATES["apache-2.0"]
    cases = [(notice.format(""), "cc-by-4.0"), (notice.format("-ShareAlike"), "cc-by-sa-4.0"), (notice.format("-NonCommercial"), ""), (notice.format("").replace("4.0", "3.0"), ""), (gpl.format("", 3), "gpl,gpl-3.0"), (gpl.format("", 2), "gpl"), (gpl.format("Lesser ", 3), ""), ("Licensed under the Apache License, Version 1.1.", "apache"), ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"), (longer, "apache,apache-2.0"), (longer.replace("2.0", "1.1"), "apache")]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_hostile_media():
    """Nesting without end, counts of 32 bits, runs out of order: nothing is read, and at once."""
    nested = b""
    for _ in range(1500):
        nested = struct.pack(">I4s", 8 + len(nested), b"moov") + nested
    assert media.probe_container(nested) == [] and len(list(media.boxes(memoryview(nested)))) == media.DEPTH + 1
    good = media.write_container(media.padded(b"x" * 3000))
    (track,) = media.probe_container(good)
    for kind, at in ((b"stsz", 12), (b"stsc", 8), (b"stts", 8), (b"stss", 8), (b"stco", 8)):
        place = good.index(kind) + at
        assert media.probe_container(good[:place] + b"\xff\xff\xff\xff" + good[place + 4 :]) == []
    rng = np.random.default_rng(1)
    for _ in range(300):
        bad = bytearray(good)
        for place in rng.integers(0, len(bad), 6):
            bad[place] = rng.integers(0, 256)
        bad[int(rng.integers(3200, len(bad)))] = 255
        assert all(len(t["offsets"]) <= len(bad) for t in media.probe_container(bytes(bad)))


def test_media_columns_against_the_stored_form(spark):
    docs = awkward(spark)
    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, set()).add(r.text or "")
    for r in media.media_digest(media.store_texts(docs)).collect():
        assert r.codec == "raw " and r.n_samples * 192 == r.payload_bytes and r.duration_s == r.n_samples / media.RATE
        assert [k.size for k in r.keyframes] == [192] * -(-r.n_samples // media.KEY_EVERY)
        starts = [k.start for k in r.keyframes]
        assert all(b - a == 192 * media.KEY_EVERY for a, b in zip(starts, starts[1:]))
        ranges = b"".join(struct.pack("<QQ", k.start, k.size) for k in r.keyframes)
        assert r.feature == f"raw|{r.duration_s:.3f}|{r.n_samples}|{len(r.keyframes)}|{zlib.crc32(ranges):08x}"
