"""Benchmark decontamination: windows of test items found in training texts, verified, and spans or documents removed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.licenses import license_words
from quillon.llm.shared import bounded_batches, materialize, pieces, tidy
from quillon.llm.textwork import WordHashes, utf8, windows

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of all distinct windows up to which they are broadcast with their items; beyond, a sieve of 2 ** SIEVE bits
#: (a fixed size, 16 MB) is, and what passes it meets the windows in a join whose keys are dealt over SALTS parts.
BROADCAST_BYTES, SIEVE, SALTS = 64 << 20, 27, 16

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
SPANS = "spans array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def item_windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, window, items): distinct windows, their words joined by blanks, and the ids (as strings) of the items
    that have them. Null and empty texts have none; windows of an item without an id have no item."""
    schema = pa.schema([("item", pa.string()), ("size", pa.int32()), ("window", pa.binary())])

    def run(batches):
        for b in pieces(batches):
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = license_words(text)
                n = min(size, len(words))
                rows += [(item, n, b" ".join(words[i : i + n])) for i in range(len(words) - n + 1) if n]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    bounded_batches(benchmark.sparkSession)
    made = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "item string, size int, window binary")
    return made.groupBy("size", "window").agg(F.collect_set("item").alias("items"))


class Known:
    """Windows by hash, with their items: what is broadcast."""

    def __init__(self, rows, size: int):
        self.size, self.lengths, hashes = size, {}, WordHashes()
        for n, window, items in rows:
            self.lengths.setdefault(n, {})[bytes(window)] = tuple(items)
        self.h = {n: np.unique(np.concatenate([windows(hashes.of(w.split()), n) for w in found])) for n, found in self.lengths.items()}

    def candidates(self, hashes: np.ndarray):
        """(window length, first word) of windows whose hash is one of the set's."""
        for n, known in self.h.items():
            grams = windows(hashes, n)
            at = np.searchsorted(known, grams)
            at[at == len(known)] = 0
            for p in np.flatnonzero(known[at] == grams):
                yield n, int(p)

    def hits(self, words: list[bytes], hashes: np.ndarray):
        """(first word, end, items) of every place of a window, verified by its words."""
        for n, p in self.candidates(hashes):
            items = self.lengths[n].get(b" ".join(words[p : p + n]))
            if items is not None:
                yield p, p + n, items


class Sieve:
    """One bit per hash of a window: passes all windows of the set and a share of others that grows with the set."""

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits, self.lengths = bits, lengths

    def candidates(self, hashes: np.ndarray):
        for n in self.lengths:
            grams = windows(hashes, n) >> np.uint64(64 - SIEVE)
            for p in np.flatnonzero((self.bits[(grams >> np.uint64(3)).astype(np.int64)] >> (grams & np.uint64(7)).astype(np.uint8)) & 1):
                yield n, int(p)


def merged(places: list[tuple[int, int]]) -> list[dict]:
    """Places (first word, end) as spans without overlaps, in order; touching ones are one."""
    out: list[dict] = []
    for start, end in sorted(places):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _sieve(table: DataFrame) -> Sieve:
    """The sieve of a table of windows: bits are set in Spark, at most 2 ** SIEVE / 32 numbers come to the driver."""
    schema = pa.schema([("slot", pa.int64()), ("bits", pa.int64())])

    def run(batches):
        hashes = WordHashes()
        for b in pieces(batches, 5000):
            grams = [int(windows(hashes.of(w.split()), n)[0] >> np.uint64(64 - SIEVE)) for n, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([g >> 5 for g in grams], pa.int64()), pa.array([1 << (g & 31) for g in grams], pa.int64())], schema=schema)

    slots = table.select("size", "window").mapInArrow(tidy(run), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (SIEVE - 5), np.uint32)
    words[slots["slot"].to_numpy()] = slots["bits"].to_numpy().astype(np.uint32)
    return Sieve(words.view(np.uint8), sorted(r.size for r in table.select("size").distinct().collect()))


def find_places(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text", keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row, n_words, spans, items) per input row: its columns (those of `keep`, or all) as a struct, merged spans of words (start, end) that
    lie in a place of a window of the benchmark, and the sorted ids of the items with such windows.

    Hashes of all windows of a text are looked up in the broadcast set and hits verified by their words. A benchmark
    whose windows don't fit the bound is looked up through a sieve of fixed size, and candidates are joined with its
    windows. Null and empty texts have no words; a text of any length is scanned whole, in linear time; repeated rows
    are scanned each; an empty table gives no rows and an empty benchmark no spans; columns of any name stay in row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    table = materialize(item_windows(benchmark, size), "benchmark-windows")
    weight = table.agg(F.sum(F.octet_length("window") + 100 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 50))).first()[0] or 0
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    small = weight <= broadcast_bytes
    known = spark.sparkContext.broadcast(Known([tuple(r) for r in table.collect()], size) if small else _sieve(table))

    def scan(batches):
        hashes = WordHashes()
        for b in pieces(batches):
            n_words, found = [], []
            for text in b.column("text").to_pylist():
                words = license_words(text)
                h = hashes.of(words)
                n_words.append(len(words))
                if small:
                    hits = list(known.value.hits(words, h))
                    found.append((merged([x[:2] for x in hits]), sorted({i for x in hits for i in x[2]})))
                else:
                    found.append([{"start": p, "end": p + n, "window": b" ".join(words[p : p + n])} for n, p in known.value.candidates(h)])
            more = [pa.array([f[0] for f in found], _SPANS), pa.array([f[1] for f in found], pa.list_(pa.string()))] if small else [pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("window", pa.binary())])))]
            names = ["spans", "items"] if small else ["near"]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n_words, pa.int64()), *more], names=["row", "n_words", *names])

    if small:
        return rows.mapInArrow(tidy(scan), f"row {kind}, n_words long, {SPANS}, items array<string>")
    scanned = materialize(rows.mapInArrow(tidy(scan), f"row {kind}, n_words long, near array<struct<start: long, end: long, window: binary>>").withColumn("rid", F.expr("uuid()")), "benchmark-candidates")
    near = scanned.select("rid", F.explode("near").alias("x")).select("rid", "x.*", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).alias("salt"))
    salted = table.select("window", "items", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    hits = near.join(salted, ["window", "salt"]).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # places in order are merged as merged() does: a span starts where a place lies beyond all ends so far
    spans = F.expr("""aggregate(places, cast(array() as array<struct<start: bigint, end: bigint>>), (a, x) ->
        case when size(a) > 0 and x.start <= element_at(a, -1).end
          then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end))))
          else concat(a, array(x)) end)""")
    found = hits.select(F.col("rid").alias("hit"), spans.alias("spans"), "items")
    empty = F.from_json(F.lit("[]"), "array<struct<start: long, end: long>>")
    return scanned.join(found, F.col("rid") == F.col("hit"), "left").select("row", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit (words in places of windows), n_items, items_sha256 (of the sorted
    ids, comma-joined), contaminated. See find_places for nulls, repeats, empties and long texts."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = find_places(slim, benchmark, size, keep=["doc_id"], **how)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and what stands between them and the next word."""
    raw, out, kept = utf8(text), [], 0
    starts = [m.start() for m in _WORD.finditer(raw)]
    for s in spans:
        out.append(raw[kept : starts[s["start"]]])
        kept = starts[s["end"]] if s["end"] < len(starts) else len(raw)
    return b"".join([*out, raw[kept:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", max_share: float = 0.0, size: int = WINDOW, text_col: str = "text", **how) -> DataFrame:
    """docs, with all their columns, less what the benchmark has.

    remove="documents": rows whose share of hit words is over max_share go. remove="spans": hit words are cut out of
    the text, and rows of which no word is left go. Rows without words stay.
    """
    found = find_places(docs, benchmark, size, text_col, **how)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    if remove == "documents":
        return found.filter((n_hit == 0) | (n_hit <= F.col("n_words") * F.lit(float(max_share)))).select("row.*")
    if remove != "spans":
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    left = found.filter((n_hit == 0) | (n_hit < F.col("n_words"))).select("row", F.col("row")[text_col].cast("string").alias("text"), "spans")
    kind = left.schema["row"].dataType.simpleString()

    def cut(batches):
        for b in pieces(batches):
            texts = [without_spans(t, s) if s else t for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return left.mapInArrow(tidy(cut), f"row {kind}, text string").select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


#: The digests by SQL; a document's windows meet the items' of the same length by their words.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda p: array_to_string(w[p : p + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM i),
p AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS a FROM d, s),
h AS (SELECT p.rid, p.a, p.size, i.item_id FROM (SELECT rid, a, size, array_to_string(w[a : a + size - 1], ' ') AS win FROM p) p JOIN i ON i.size = p.size AND i.win = p.win),
n AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(a, a + size)) FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN t ON t.rid = d.rid
"""
