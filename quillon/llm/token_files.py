"""Token ids in Arrow stream files of equal-length sequences and masks."""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import batch, id_and_text, pieces, shared_dir, tidy
from quillon.llm.tokens import chunk_ids, library

#: Ids in a sequence; sequences in a record batch.
LENGTH, ROWS = 2048, 256
#: Bytes of input files, or else of texts, for which a token file of its own is made.
FILE_BYTES = 256 << 20


def _store(path: str):
    """pyarrow file system and inner path of a URI or a plain path; works for any store pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class SequenceWriter:
    """Packs ids into sequences of LENGTH and writes them as record batches of (ids, mask) fixed-size lists.

    The mask is a byte an id (1: an id of a document, 0: filled up), so that it is read without a copy as well. As
    all sequences but a file's last are full, masks are dictionary-encoded: each stands in the file once.
    """

    def __init__(self, sink, width: int, length: int = LENGTH, rows: int = ROWS):
        kind = pa.uint16() if width == 2 else pa.uint32()
        self.dtype, self.length, self.rows = np.dtype(f"<u{width}"), length, rows
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.dictionary(pa.int32(), pa.list_(pa.uint8(), length)))])
        self.out, self.held, self.size = pa.ipc.new_stream(sink, self.schema), [], 0

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        self.size += len(raw) // self.dtype.itemsize
        if self.size >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        block, at = self.length * self.rows, 0
        while len(ids) - at >= block:
            self._write(ids[at : at + block], block)
            at += block
        rest = ids[at:]
        if last and len(rest):
            n = -(-len(rest) // self.length) * self.length
            self._write(np.concatenate([rest, np.zeros(n - len(rest), self.dtype)]), len(rest))
            rest = rest[:0]
        self.held, self.size = [rest.tobytes()], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        n, full = len(ids) // self.length, real // self.length
        masks = [np.ones(self.length, np.uint8)] + [(np.arange(self.length) < real - full * self.length).astype(np.uint8)] * (n > full)
        lists = lambda v, kind: pa.FixedSizeListArray.from_arrays(pa.array(v), type=kind)
        places = pa.array([0] * full + [1] * (n - full), pa.int32())
        mask = pa.DictionaryArray.from_arrays(places, lists(np.concatenate(masks), self.schema.field("mask").type.value_type))
        self.out.write_batch(pa.RecordBatch.from_arrays([lists(ids, self.schema.field("ids").type), mask], schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class SequenceReader:
    """Random access to a file's sequences; of a local file the buffers are memory-mapped and not copied."""

    def __init__(self, path: str):
        store, inner = _store(path)
        self.source = pa.memory_map(inner) if store.type_name == "local" else store.open_input_file(inner)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.first = np.cumsum([0, *(b.num_rows for b in self.batches)])
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else LENGTH

    def __len__(self) -> int:
        return int(self.first[-1])

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, boolean mask) of sequence i, views of the file's buffers."""
        at = int(np.searchsorted(self.first, i, "right")) - 1
        ids, mask = self.batches[at].columns
        row = i - int(self.first[at])
        one = lambda lists, place: lists.slice(place, 1).flatten().to_numpy(zero_copy_only=True)
        return one(ids, row), one(mask.dictionary, mask.indices[row].as_py()).view(np.bool_)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th real id of the file on."""
        out, at, end = [], start, start + n
        while at < end:
            row = at // self.length
            b = int(np.searchsorted(self.first, row, "right")) - 1
            stop = min(end, int(self.first[b + 1]) * self.length)
            skip = at - int(self.first[b]) * self.length
            out.append(self.batches[b].column("ids").flatten().to_numpy()[skip : skip + stop - at])
            at = stop
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)


def input_bytes(docs: DataFrame, text_col: str) -> int:
    """Size of the files that docs reads, from their metadata alone; of a plan without files, the texts' bytes."""
    try:
        files = docs.select("_metadata.file_path", "_metadata.file_size").distinct()
    except AnalysisException:
        files = docs.select(F.octet_length(F.col(text_col).cast("string")).cast("long").alias("file_size"))
    return files.agg(F.sum("file_size")).first()[0] or 0


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, rows: int = ROWS, files: int | None = None) -> DataFrame:
    """Write the ids of all documents, each closed by end_id, in ascending doc_id order; returns one row per file.

    Rows are dealt by ranges of (doc_id, hash of the text), nulls first, so a file never needs one machine for a
    repeated id alone; equal rows may lie in any order among themselves. File k holds range k: `part-k-x.arrow`
    (sequences and masks) and `part-k-x.index.arrow` (doc_id, start in the file, n_tokens), x being the attempt's own.
    Only attempts that ended well stand in the manifest, with both of their files, so tasks can be lost and run again
    and readers that go by it never see files of two attempts. The result has part, path, n_docs, n_tokens and start
    (ids in all files before), and manifest.json holds the same; both are one row per file, not per document. Null and
    empty texts are end_id alone; an empty table gives no files. files: how many ranges; else as many as shuffle
    partitions, or one for each FILE_BYTES of the input if that is more.
    """
    spark = docs.sparkSession
    width = 2 if library(vocabulary).get_vocab_size() <= 1 << 16 else 4
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs, text_col) // FILE_BYTES))
    slim = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).withColumn("rid", F.monotonically_increasing_id())
    dealt = slim.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h", "rid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "rid").select("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, writer = TaskContext.get().partitionId(), None
        store, inner = _store(path)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        mine = f"{inner}/{name}"
        ids, end, start, n_docs = chunk_ids(vocabulary, width), end_id.to_bytes(width, "little"), 0, 0
        kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for b in pieces(batches):
            if writer is None:
                store.create_dir(inner, recursive=True)
                sinks = [store.open_output_stream(f"{mine}.arrow"), store.open_output_stream(f"{mine}.index.arrow")]
                writer, index = SequenceWriter(sinks[0], width, length, rows), pa.ipc.new_stream(sinks[1], kind)
            found = []
            for doc, raw in zip(b.column(0).to_pylist(), ids.texts(b.column(1).to_pylist())):
                raw += end
                writer.add(raw)
                found.append((doc, start, len(raw) // width))
                start += len(raw) // width
            if found:
                index.write_batch(batch(kind, list(zip(*found))))
                n_docs += len(found)
        if writer is not None:
            for x in (writer, index, *sinks):
                x.close()
            yield batch(schema, [[part], [f"{path.rstrip('/')}/{name}"], [n_docs], [start]])

    made = dealt.mapInArrow(tidy(run, keeps_words=True), "part int, path string, n_docs long, n_tokens long").collect()  # a row per file
    table, before = [], 0
    for r in sorted(made, key=lambda r: r.part):
        table.append((r.part, r.path, r.n_docs, r.n_tokens, before))
        before += r.n_tokens
    if table:
        store, inner = _store(path)
        with store.open_output_stream(f"{inner}/manifest.json") as f:
            f.write(json.dumps([dict(zip(("part", "path", "n_docs", "n_tokens", "start"), t)) for t in table]).encode())
    return spark.createDataFrame(table, "part int, path string, n_docs long, n_tokens long, start long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files of a manifest, one task per file at most.

    start counts the ids of all documents before; ids_crc32 is over 32-bit little-endian ids. Every document's ids
    are fetched by position from the memory-mapped sequences.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader = SequenceReader(f"{path}.arrow")
                store, inner = _store(path)
                with store.open_input_file(f"{inner}.index.arrow") as f:
                    for rows in pa.ipc.open_stream(f):
                        at, n = rows.column(1).to_pylist(), rows.column(2).to_pylist()
                        crc = [zlib.crc32(reader.span(a, k).astype("<u4").tobytes()) for a, k in zip(at, n)]
                        yield batch(schema, [rows.column(0), [base + a for a in at], n, crc])

    files = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("path", "start").repartition(files).mapInArrow(tidy(run, keeps_words=True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    """A folder for token files in the shared folder."""
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
