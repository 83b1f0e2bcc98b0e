"""Cost-balanced packing of documents into fixed-length sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.shared import batch, id_and_text, pieces, tidy
from quillon.llm.tokens import chunk_ids

LENGTH = 4096
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that are packed together; bounds a worker's memory.
WINDOW = 2_000_000


def pack_window(lengths: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(pieces (document, start, length, sequence, offset), number of sequences).

    Whole sequences are cut off documents that are longer than one. The rest are assigned in descending length,
    each to the sequence of lowest cost among those with room for it; one that fits nowhere is cut, its parts
    going to the cheapest sequences with room. There are as many full sequences as the tokens fill; the tokens
    left over form sequences of power-of-two lengths, so that nothing is padded.
    """
    out, n_seq, rest = [], 0, []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= length:
            out.append((doc, start, length, n_seq, 0))
            n_seq, start = n_seq + 1, start + length
        if n > start:
            rest.append((n - start, doc, start))
    full, tail = divmod(sum(r[0] for r in rest), length)
    caps = np.array([length] * full + [1 << i for i in range(tail.bit_length() - 1, -1, -1) if tail >> i & 1], dtype=np.int64)
    left, cost = caps.copy(), np.zeros(len(caps))
    for n, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            fits = left >= n
            if not fits.any():
                fits = left > 0
            s = int(np.where(fits, cost, np.inf).argmin())
            take = min(n, int(left[s]))
            out.append((doc, start, take, n_seq + s, int(caps[s] - left[s])))
            left[s] -= take
            cost[s] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return out, n_seq + len(caps)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids: array<int>).

    A document is the ids of its text and then end_id; every id lies in exactly one piece. Each task packs its own
    rows, at least `window` tokens at a time (one document more when it is long), so there is no shuffle and no
    group that grows with the input; sequence_id is (task << 32) + a running number and is the same when a lost
    task runs again. Null and empty texts are end_id alone; null ids stay null; repeated rows are packed each; an
    empty table gives no rows; extra columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches):
        from pyspark import TaskContext

        ids, end = chunk_ids(vocabulary), end_id.to_bytes(4, "little")
        base, held, size = TaskContext.get().partitionId() << 32, [], 0

        def pack():
            nonlocal base
            found, n_seq = pack_window([len(r) // 4 for _, r in held], length, linear, quadratic)
            rows = []
            for doc, start, n, seq, offset in found:
                part = held[doc][1][4 * start : 4 * (start + n)]
                row = (held[doc][0], start, n, zlib.crc32(part), len(held[doc][1]) // 4, base + seq, offset)
                rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
            base += n_seq
            return batch(schema, list(zip(*rows)) if rows else [[]] * len(schema))

        for b in pieces(batches):
            for doc, raw in zip(b.column(0).to_pylist(), ids.texts(b.column(1).to_pylist())):
                held.append((doc, raw + end))
                size += len(held[-1][1]) // 4
                if size >= window:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()

    return id_and_text(docs, id_col, text_col).mapInArrow(tidy(run, keeps_words=True), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
