"""ISO media containers (ISO/IEC 14496-12): write payloads as raw samples, walk boxes, decode sample tables.

`write_container` stores bytes as uncompressed video samples of one size in a movie file (ftyp, mdat, moov).
`probe_container` reads any such file: it walks nested boxes, decodes the tables (stsd, stts, stsc, stsz or
stz2, stco or co64, stss) and gives codec, duration and the keyframes' byte ranges. Payloads are never decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import batch, id_and_text, pieces, tidy
from quillon.llm.textwork import utf8

#: Bytes of a sample: 8 x 8 pixels of three 8-bit channels.
SAMPLE, SIDE, PAD = 192, 8, b" "
#: Every so many samples one is marked as a sync sample; samples per second; samples per chunk.
KEY_EVERY, RATE, PER_CHUNK = 12, 25, 64
#: Levels of boxes that are opened.
DEPTH = 16
#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta"}


def _box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    if size > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(body)
    return struct.pack(">I4s", size, kind) + b"".join(body)


def _full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


def padded(raw: bytes) -> bytes:
    """raw and blanks up to a positive multiple of SAMPLE."""
    return raw + PAD * (SAMPLE * max(1, -(-len(raw) // SAMPLE)) - len(raw))


def write_container(payload: bytes) -> bytes:
    """A movie file of one raw video track; len(payload) must be a positive multiple of SAMPLE."""
    n, rest = divmod(len(payload), SAMPLE)
    if rest or not n:
        raise ValueError("payload must be a positive multiple of the sample size")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    media = _box(b"mdat", payload)
    start = len(ftyp) + len(media) - len(payload)
    offsets = [start + i * SAMPLE for i in range(0, n, PER_CHUNK)]
    full, tail = divmod(n, PER_CHUNK)
    chunks = ([(1, PER_CHUNK, 1)] if full else []) + ([(full + 1, tail, 1)] if tail else [])
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", SIDE, SIDE), struct.pack(">II", 72 << 16, 72 << 16), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 24, -1))
    keys = range(1, n + 1, KEY_EVERY)
    wide = offsets[-1] > 0xFFFFFFFF
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        _full(b"stsc", struct.pack(">I", len(chunks)), *(struct.pack(">III", *c) for c in chunks)),
        _full(b"stsz", struct.pack(">II", SAMPLE, n)),
        _full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
    )
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"samples\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return ftyp + media + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def boxes(data: memoryview, at: int = 0, end: int | None = None, path: bytes = b""):
    """(path, start of body, end) of every box, parents before children; a cut-off box ends its level.

    Containers more than DEPTH levels deep aren't opened: no real file nests so far, and a path grows with its depth.
    """
    levels = [(at, len(data) if end is None else end, path)]
    while levels:
        at, end, path = levels.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        stop = end if size == 0 else at + size
        if size and size < head or stop > end:
            continue
        yield path + kind, at + head, stop
        levels.append((stop, end, path))
        if kind in CONTAINERS and path.count(b"/") < DEPTH:
            levels.append((at + head, stop, path + kind + b"/"))


def _u32s(data: memoryview, at: int, n: int, step: int = 1) -> list[tuple]:
    """n entries of `step` 32-bit numbers; a count of more entries than there are bytes is an error."""
    if 4 * step * n > len(data) - at:
        raise ValueError("table is longer than the file")
    return list(struct.iter_unpack(f">{step}I", data[at : at + 4 * step * n]))


def _sizes(data: memoryview, at: dict[bytes, int]) -> list[int]:
    """Sample sizes of stsz or stz2. A count of samples that hold more bytes than the file is an error."""
    if b"stsz" in at:
        one, n = struct.unpack_from(">II", data, at[b"stsz"] + 4)
        if one * n > len(data):
            raise ValueError("samples are larger than the file")
        return [one] * n if one else [s for (s,) in _u32s(data, at[b"stsz"] + 12, n)]
    field, n = struct.unpack_from(">II", data, at[b"stz2"] + 4)
    field &= 0xFF
    raw = data[at[b"stz2"] + 12 :]
    if field not in (4, 8, 16) or n * field > 8 * len(raw):
        raise ValueError("no table of compact sizes")
    return [raw[i // 2] >> (0 if i % 2 else 4) & 15 if field == 4 else int.from_bytes(raw[i * field // 8 : (i + 1) * field // 8], "big") for i in range(n)]


def _track(data: memoryview, parts: dict[bytes, tuple[int, int]]) -> dict:
    at = {k.rpartition(b"/")[2]: v[0] for k, v in parts.items()}
    version = data[at[b"mdhd"]]
    scale, duration = struct.unpack_from(">IQ" if version else ">II", data, at[b"mdhd"] + (20 if version else 12))
    codec = bytes(data[at[b"stsd"] + 12 : at[b"stsd"] + 16]).decode("latin-1")
    handler = bytes(data[at[b"hdlr"] + 8 : at[b"hdlr"] + 12]).decode("latin-1")
    sizes = _sizes(data, at)
    if b"co64" in at:
        (n,) = struct.unpack_from(">I", data, at[b"co64"] + 4)
        starts = list(struct.unpack_from(f">{n}Q", data, at[b"co64"] + 8))
    else:
        (n,) = struct.unpack_from(">I", data, at[b"stco"] + 4)
        starts = list(struct.unpack_from(f">{n}I", data, at[b"stco"] + 8))
    (n,) = struct.unpack_from(">I", data, at[b"stsc"] + 4)
    if any(a[0] >= b[0] for a, b in pairwise(_u32s(data, at[b"stsc"] + 8, n, 3))):
        raise ValueError("runs of chunks are out of order")
    runs = _u32s(data, at[b"stsc"] + 8, n, 3)
    offsets: list[int] = []
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(starts)
        for chunk in range(first - 1, min(last, len(starts))):
            if len(offsets) >= len(sizes):
                break
            here = starts[chunk]
            for size in sizes[len(offsets) : len(offsets) + per]:
                offsets.append(here)
                here += size
    if b"stss" in at:
        (n,) = struct.unpack_from(">I", data, at[b"stss"] + 4)
        keys = [k - 1 for (k,) in _u32s(data, at[b"stss"] + 8, n)]
    else:  # every sample is a sync sample
        keys = list(range(len(offsets)))
    (n,) = struct.unpack_from(">I", data, at[b"stts"] + 4)
    ticks = sum(c * d for c, d in _u32s(data, at[b"stts"] + 8, n, 2))
    return {"handler": handler, "codec": codec, "timescale": scale, "duration": duration, "ticks": ticks, "offsets": offsets, "sizes": sizes[: len(offsets)], "keyframes": [(offsets[k], sizes[k]) for k in keys if 0 <= k < len(offsets)]}


def probe_container(media: bytes | memoryview) -> list[dict]:
    """One dict per track that has a sample table; [] when nothing can be read."""
    data, tracks = memoryview(media), []
    for path, start, end in boxes(data):
        if path in (b"trak", b"moov/trak"):
            parts = {p: (s, e) for p, s, e in boxes(data, start, end)}
            try:
                tracks.append(_track(data, parts))
            except (KeyError, IndexError, ValueError, struct.error):
                continue
    return tracks


def read_samples(media: bytes | memoryview, track: dict) -> bytes:
    """The samples' bytes, one after the other, neighbouring ones read as one span."""
    data, out, at = memoryview(media), [], 0
    offsets, sizes = track["offsets"], track["sizes"]
    while at < len(offsets):
        start = end = offsets[at]
        while at < len(offsets) and offsets[at] == end:
            end += sizes[at]
            at += 1
        out.append(data[start:end])
    return b"".join(out)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): every text as UTF-8, padded, in a container of its own.

    A null or empty text is one sample of blanks with n_bytes 0. Null ids stay; repeated rows each give a row;
    an empty table gives no rows; extra columns are ignored. No shuffle; memory is that of a few texts.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in pieces(batches, 200):
            raw = [utf8(t) for t in b.column(1).to_pylist()]
            yield batch(schema, [b.column(0), [len(r) for r in raw], [write_container(padded(r)) for r in raw]])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


PROBED = "codec string, duration_s double, n_samples long, keyframes array<struct<start:long,size:long>>"
PROBED_FIELDS = [("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))]


def probed(track: dict | None) -> tuple:
    """The columns of PROBED from a track; no track: nulls, no samples and no keyframes."""
    if track is None:
        return None, None, 0, []
    return track["codec"], track["duration"] / max(1, track["timescale"]), len(track["offsets"]), [{"start": s, "size": n} for s, n in track["keyframes"]]


def probe_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with codec, duration_s, n_samples and keyframe byte ranges of its first track instead of the media.

    Null or unreadable media give nulls (n_samples 0, no keyframes). Other columns pass through untouched.
    """
    keep = [c for c in df.columns if c != media_col]
    arrow = pa.schema(PROBED_FIELDS)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches):
        for b in pieces(batches, 200):
            at = b.schema.get_field_index(media_col)
            found = [probed(next(iter(probe_container(m or b"")), None)) for m in b.column(at).to_pylist()]
            more = batch(arrow, [list(c) for c in zip(*found)] or [[]] * len(arrow))
            rest = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(rest + more.columns, names=keep + arrow.names)

    return df.mapInArrow(tidy(run), f"{fields}{', ' if fields else ''}{PROBED}")


def media_digest(stored: DataFrame) -> DataFrame:
    """Digest of store_texts' rows from the stored bytes alone.

    Adds payload_bytes, payload_sha256, tail_crc32 (last 16 bytes of the payload), media_bytes, media_sha256,
    feature ("codec|seconds|samples|keyframes|crc of the keyframe ranges"), and the columns of PROBED: codec,
    duration_s, n_samples and the keyframes' byte ranges. The stored bytes are those that store_texts writes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), *PROBED_FIELDS])

    def row(doc, n, media):
        track = probe_container(media)[0]
        payload = read_samples(media, track)
        keys = track["keyframes"]
        ranges = struct.pack(f"<{2 * len(keys)}Q", *(x for k in keys for x in k))
        feature = f"{track['codec'].strip()}|{track['duration'] / track['timescale']:.3f}|{len(track['sizes'])}|{len(keys)}|{zlib.crc32(ranges):08x}"
        return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, *probed(track)

    def run(batches):
        for b in pieces(batches, 200):
            rows = [row(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield batch(schema, list(zip(*rows)) if rows else [[]] * len(schema))

    return stored.select("doc_id", "n_bytes", F.col("media")).mapInArrow(tidy(run), f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, {PROBED}")
