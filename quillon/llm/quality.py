"""Quality rules: compression bands beside a small set of base counts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import batch, bounded_batches, id_and_text, pieces, tidy
from quillon.llm.textwork import WordHashes, space_words, utf8, windows

#: Bands of raw size / zstandard size by UTF-8 size: (up to so many bytes, lowest, highest ratio). Prose of any
#: language compresses better the longer it is, so each length has its own limits; they leave about 0.1 beyond
#: what the rows labelled good show.
BANDS = ((128, 0.5, 1.45), (256, 0.9, 2.1), (512, 1.2, 2.05), (1024, 1.3, 2.1), (2048, 1.5, 2.25), (4096, 1.65, 2.32), (8192, 1.8, 2.45), (16384, 2.0, 2.52), (65536, 2.1, 2.68), (float("inf"), 2.1, 2.85))
#: Chunks of so many bytes (the last one ends with the text and may overlap the one before), their band, and the largest
#: share of chunks allowed outside it. A text of less than a chunk has the band of its whole.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 1024, (1.3, 2.25), 0.1
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

_SYMBOLS = re.compile(rb"[#*$%&|<>]")


def band_verdict(raw: bytes, compress, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE) -> tuple[float, float, bool]:
    """(ratio of the whole, share of chunks outside the chunk band, kept). Empty: (0, 0, False)."""
    if not raw:
        return 0.0, 0.0, False
    ratio = len(raw) / len(compress(raw))
    low, high = next((lo, hi) for size, lo, hi in bands if len(raw) <= size)
    ends = [*range(chunk, len(raw) + 1, chunk)]
    if ends and ends[-1] < len(raw):
        ends.append(len(raw))
    outside = sum(not chunk_band[0] <= chunk / len(compress(raw[end - chunk : end])) <= chunk_band[1] for end in ends)
    share = outside / len(ends) if ends else 0.0
    return ratio, share, low <= ratio <= high and share <= chunk_share


def repeat_words(hashes: np.ndarray, k: int = WINDOW) -> int:
    """Words inside k-word windows that occur twice or more, all occurrences included."""
    w = windows(hashes, k)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def dup_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line.split():
            n += line in seen
            seen.add(line)
    return n


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE, level: int = LEVEL) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, ratio, odd_chunks (the share of chunks outside their band).

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed and
    the compression bands hold. Null and empty texts have zeros and fail; null ids stay; repeated rows are judged
    each; an empty table gives no rows; extra columns are ignored. One pass, no shuffle.
    """
    types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
    schema = pa.schema(list(zip(["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "odd_chunks"], types)))

    def run(batches):
        import zstandard

        compress, hashes = zstandard.ZstdCompressor(level=level).compress, WordHashes()
        for b in pieces(batches):
            rows = []
            for text in b.column(1).to_pylist():
                raw = utf8(text)
                words = space_words(raw)
                n = len(words)
                chars = len(text or "") - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
                repeat = repeat_words(hashes.of(words))
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                ratio, share, good = band_verdict(raw, compress, bands, chunk, chunk_band, chunk_share)
                rows.append((n, chars, len(_SYMBOLS.findall(raw)), dup_lines(raw), repeat, failed, good and not failed, ratio, share))
            yield batch(schema, [b.column(0), *(list(c) for c in zip(*rows))] if rows else [[]] * len(schema))

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, odd_chunks double")


def keep_good(docs: DataFrame, text_col: str = "text", bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE, level: int = LEVEL) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns; one pass without a join.

    Nulls and empty texts go; a repeated row stays or goes as often as it occurs.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        import zstandard

        compress, hashes = zstandard.ZstdCompressor(level=level).compress, WordHashes()
        for b in pieces(batches):
            keep = []
            for text in b.column(at).to_pylist():
                raw = utf8(text)
                words = space_words(raw)
                good = len(words) >= MIN_WORDS and 100 * repeat_words(hashes.of(words)) <= MAX_REPEAT_PERCENT * len(words)
                keep.append(good and band_verdict(raw, compress, bands, chunk, chunk_band, chunk_share)[2])
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(tidy(run), docs.withColumn(text_col, F.col(text_col).cast("string")).schema)
