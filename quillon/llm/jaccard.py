"""N-gram Jaccard join: exact links between documents by rare-first prefix filtering.

1. Every document becomes its set of 5-word shingles (64-bit hashes). Chunks of documents send each distinct
   hash once, packed, to a bucket of the hash range, where the exact document frequency of every hash is found;
   only hashes of two documents or more are sent back to the chunks.
2. Each chunk orders its documents' sets by (frequency, hash), rarest first, and keeps the prefix in which a
   partner at the threshold must share a hash. Hashes of one document fill prefixes but cannot match, so most
   documents leave nothing. Equal sets are one class from here on.
3. Classes with a common prefix hash are candidates if the length and positional filters let them pass. To avoid
   all pairs of a large group, each prefix hash first proposes only pairs with one class, the one that shares most
   of its prefix (an original has all of its hashes in its copies, a copy has some of its own); these are verified
   once each (suffix filter, then the exact overlap) and joined to components. Then, for hashes whose
   classes still lie in different components, all remaining pairs across components are verified the same way.
   A pair inside one component cannot change the result, so the components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.shared import batch, bounded_batches, discard, id_and_text, materialize, pieces, stable_splits, tidy
from quillon.llm.textwork import WordHashes, shingle_set, sorted_overlap, space_words, utf8

#: Words in a shingle; similarity in percent.
K, PERCENT = 5, 80
#: Hashes of a chunk of documents; hashes of a bucket aimed at; bounds of the number of buckets (powers of two).
CHUNK, BUCKET, BUCKETS = 700_000, 700_000, (64, 65536)
#: Candidate documents up to which their ids (8 bytes each) are broadcast to fetch their texts; beyond, a join.
BROADCAST_IDS = 500_000
#: Local number of a hash that several documents of its chunk have.
_MANY = 0xFFFF
_DIGEST = 16
_LOW40 = np.uint64((1 << 40) - 1)


def _digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def text_shingles(hashes: WordHashes, text: str | None, k: int = K) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    return shingle_set(hashes.of(space_words(utf8(text).lower())), k)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """A set of n that is linked shares one of its first n - ceil(p n) + 1 hashes with its partner's."""
    return n - -(-percent * n // 100) + 1


def least_overlap(n1: int, n2: int, percent: int = PERCENT) -> int:
    """Smallest overlap at which sets of n1 and n2 are linked."""
    return -(-percent * (n1 + n2) // (100 + percent))


def suffix_bound(a: np.ndarray, b: np.ndarray, parts: int = 16) -> int:
    """Upper bound of the overlap: cut both sets at the same hashes and sum the smaller part sizes."""
    cuts = b[np.arange(1, parts) * len(b) // parts]
    na, nb = (np.diff(np.concatenate(([0], np.searchsorted(x, cuts), [len(x)]))) for x in (a, b))
    return int(np.minimum(na, nb).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the threshold; the suffix filter comes first."""
    need = least_overlap(len(a), len(b), percent)
    if min(len(a), len(b)) < need or suffix_bound(a, b) < need:
        return False
    both = sorted_overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _pack(h40: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Seven bytes a posting: 40 bits of the hash and the document's number in its chunk."""
    out = np.empty((len(h40), 7), np.uint8)
    out[:, :5] = h40.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5:] = doc.astype("<u2").view(np.uint8).reshape(-1, 2)
    return out


def _unpack(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = raw.reshape(-1, 7)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :5] = rows[:, :5]
    return wide.view("<u8").ravel(), np.ascontiguousarray(rows[:, 5:]).view("<u2").ravel()


def _chunks(buckets: int, k: int, chunk: int):
    """mapInArrow: documents -> (bucket, chunk, kind, payload); kind 0: postings, 1: the chunk's own table."""
    shift, schema = np.uint64(64 - (buckets.bit_length() - 1)), pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int8()), ("payload", pa.binary())])

    def flush(ids, sets, number):
        import pickle

        sizes = np.array([len(s) for s in sets], np.int64)
        alls = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        # the hash's top bits are its bucket, the next 40 are kept
        short = alls >> (shift - np.uint64(40))
        docs = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(short, kind="stable")
        short, docs = short[order], docs[order]
        new = np.ones(len(short), bool)
        new[1:] = short[1:] != short[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(short)))
        one = docs[first].copy()
        # several documents here: the table keeps who they are, the bucket learns only that there are several
        many = np.repeat(count, count) > 1
        one[count > 1] = _MANY
        keep = (ids, sizes.tolist(), [_digest(s) for s in sets], short[many].tobytes(), docs[many].astype("<u2").tobytes())
        packed = _pack(short[first] & _LOW40, one)
        edges = np.searchsorted(short[first] >> np.uint64(40), np.arange(buckets + 1))
        rows = [(i, number, 0, packed[edges[i] : edges[i + 1]].tobytes()) for i in range(buckets) if edges[i] < edges[i + 1]]
        return batch(schema, list(zip(*rows, ((number ^ number >> 32) % buckets, number, 1, pickle.dumps(keep)))))

    def run(batches):
        from pyspark import TaskContext

        hashes, number = WordHashes(), TaskContext.get().partitionId() << 32
        ids, sets, size = [], [], 0
        for b in pieces(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                sets.append(text_shingles(hashes, text.as_py(), k))
                ids.append(doc)
                size += len(sets[-1])
                if size >= chunk or len(ids) == _MANY:
                    yield flush(ids, sets, number)
                    ids, sets, size, number = [], [], 0, number + 1
        if ids:
            yield flush(ids, sets, number)

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """All rows of a bucket -> (chunk, bucket, payload): postings that two documents or more have, with how many.

    A chunk in which several documents have a hash counts as two: enough to tell rare from common, and the same
    for every chunk that gets the answer.
    """
    bucket = table.column("bucket")[0].as_py()
    chunk, kind, payload = table.column("chunk").to_pylist(), table.column("kind").to_pylist(), table.column("payload")
    rows = [(c, -1, payload[i].as_py()) for i, (c, k) in enumerate(zip(chunk, kind)) if k]
    own = [i for i, k in enumerate(kind) if not k]
    if own:
        parts = [np.frombuffer(payload[i].as_buffer(), np.uint8) for i in own]
        h, doc = _unpack(np.concatenate(parts))
        of = np.repeat(np.arange(len(own), dtype=np.int32), [len(p) // 7 for p in parts])
        del parts
        order = np.argsort(h, kind="stable")
        h, doc, of = h[order], doc[order], of[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        run = np.cumsum(first) - 1
        df = np.bincount(run, weights=np.where(doc == _MANY, 2, 1)).astype("<u4")[run] if len(h) else np.empty(0, "<u4")
        keep = df > 1
        h, doc, of, df = h[keep], doc[keep], of[keep], df[keep]
        order = np.argsort(of, kind="stable")
        h, doc, of, df = h[order], doc[order], of[order], df[order]
        edges = np.searchsorted(of, np.arange(len(own) + 1))
        for j, i in enumerate(own):
            a, z = edges[j], edges[j + 1]
            if a < z:
                rows.append((chunk[i], bucket, _pack(h[a:z], doc[a:z]).tobytes() + df[a:z].tobytes()))
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), schema.types)], schema=schema)


def _prefixes(percent: int):
    """applyInArrow: all rows of a chunk -> (doc_id, n, key, prefix): the shared hashes of each prefix by place."""
    item = pa.struct([("h", pa.int64()), ("pos", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("prefix", pa.list_(item))])

    def run(table: pa.Table) -> pa.Table:
        import pickle

        bucket, payload = table.column("bucket").to_pylist(), table.column("payload")
        ids, sizes, keys, many_h, many_doc = pickle.loads(payload[bucket.index(-1)].as_py())
        many_h, many_doc = np.frombuffer(many_h, np.uint64), np.frombuffer(many_doc, "<u2")
        hs, docs, dfs = [], [], []
        for i, b in enumerate(bucket):
            if b < 0:
                continue
            raw = np.frombuffer(payload[i].as_buffer(), np.uint8)
            n = len(raw) // 11
            h, doc = _unpack(raw[: 7 * n])
            h = h | (np.uint64(b) << np.uint64(40))
            df = np.frombuffer(raw[7 * n :].tobytes(), "<u4")
            single = doc != _MANY
            hs.append(h[single]), docs.append(doc[single].astype(np.int64)), dfs.append(df[single])
            if not single.all():
                # all documents of this chunk that have the hash
                start, stop = np.searchsorted(many_h, h[~single]), np.searchsorted(many_h, h[~single], "right")
                at = np.concatenate([np.arange(a, z) for a, z in zip(start, stop)])
                hs.append(many_h[at]), docs.append(many_doc[at].astype(np.int64)), dfs.append(np.repeat(df[~single], stop - start))
        h, doc, df = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((hs, np.uint64), (docs, np.int64), (dfs, np.uint32)))
        order = np.lexsort((h, df, doc))
        h, doc = h[order], doc[order]
        sizes = np.array(sizes, np.int64)
        shared = np.bincount(doc, minlength=len(ids)) if len(doc) else np.zeros(len(ids), np.int64)
        first = np.cumsum(shared) - shared
        pos = np.arange(len(h)) - first[doc] + (sizes - shared)[doc] if len(h) else np.empty(0, np.int64)
        keep = pos < (sizes - -(-percent * sizes // 100) + 1)[doc] if len(h) else np.empty(0, bool)
        n = np.bincount(doc[keep], minlength=len(ids)) if len(h) else np.zeros(len(ids), np.int64)
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(pos[keep].astype(np.int32))], fields=list(item))
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values).cast(pa.list_(item))], schema=schema)

    return run


def prefixes(docs: DataFrame, k: int = K, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, key, prefix) per row of docs (doc_id, text); key is a digest of the shingle set."""
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    buckets = 1 << min(max(words // BUCKET, BUCKETS[0]).bit_length(), BUCKETS[1].bit_length() - 1)
    sent = docs.mapInArrow(tidy(_chunks(buckets, k, chunk)), "bucket int, chunk long, kind byte, payload binary")
    back = sent.groupBy("bucket").applyInArrow(_frequencies, "chunk long, bucket int, payload binary")
    return back.groupBy("chunk").applyInArrow(_prefixes(percent), "doc_id long, n long, key binary, prefix array<struct<h:long,pos:int>>")


def _passes(percent: int, a: str, b: str) -> str:
    """Length filter, and positional filter: what follows the common hash in both must reach the least overlap."""
    n1, n2, p1, p2 = f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and {100 + percent} * least({n1} - {p1}, {n2} - {p2}) >= {percent} * ({n1} + {n2})"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (u, v) -> those that reach the threshold; each is looked at once."""
    both = pairs.join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("key").alias("v"), F.col("shingles").alias("sv")), "v").select("u", "v", "su", "sv")

    def run(batches):
        for b in pieces(batches):
            good = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3))]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(tidy(run), "u binary, v binary")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(key, shingles) of the classes in wanted (key, doc_id)."""
    n = wanted.count()
    ids = wanted.select(F.col("doc_id").alias("w")).distinct()
    few = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, docs.doc_id.eqNullSafe(ids.w), "left_semi")

    def run(batches):
        hashes, schema = WordHashes(), pa.schema([("key", pa.binary()), ("shingles", pa.binary())])
        for b in pieces(batches):
            found = [text_shingles(hashes, t.as_py(), k) for t in b.column(1)]
            yield batch(schema, [[_digest(s) for s in found], [s.tobytes() for s in found]])

    made = few.select("doc_id", "text").mapInArrow(tidy(run), "key binary, shingles binary")
    return made.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))


def link_classes(docs: DataFrame, k: int = K, percent: int = PERCENT, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(rows, roots) for docs (doc_id, text): rows (doc_id, n, key), one per row; roots (key, root) of linked classes."""
    bounded_batches(docs.sparkSession)
    meta = materialize(prefixes(docs, k, percent, chunk), "jaccard-prefixes")
    classes = meta.filter("n > 0").groupBy("key").agg(F.min_by(F.struct("doc_id", "n", "prefix"), F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("x")).select("key", "x.doc_id", "x.n", "x.prefix")
    posted = materialize(classes.filter(F.size("prefix") > 0).select("key", "doc_id", "n", F.size("prefix").alias("shared"), F.inline("prefix")), "jaccard-postings")
    low = posted.groupBy("h").agg(F.min(F.struct(-F.col("shared"), "key", "n", "pos")).alias("b"), F.count("*").alias("m")).filter("m > 1").select(F.col("h").alias("h_"), "b")
    star = posted.withColumn("a", F.struct("n", "pos")).join(low, F.col("h") == F.col("h_")).filter(F.col("key") != F.col("b.key")).filter(_passes(percent, "a", "b")).select(F.col("b.key").alias("u"), F.col("key").alias("v")).distinct()
    star = materialize(star, "jaccard-star")
    names = posted.select("key", "doc_id").distinct()
    proposed = star.select(F.col("u").alias("key")).unionAll(star.select(F.col("v").alias("key"))).distinct()
    sets = materialize(_sets(docs, names.join(proposed, "key", "left_semi"), k), "jaccard-sets")
    links = materialize(_verified(star, sets, percent), "jaccard-links")
    roots = components(links, "jaccard-components")
    # hashes whose classes are not all in one component yet: pairs across components
    placed = posted.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("h")
    left = materialize(placed.join(mixed, "h", "left_semi").select("h", "key", "root", "n", "pos"), "jaccard-mixed")
    rest = left.alias("a").join(left.alias("b"), F.expr("a.h = b.h and a.root <> b.root and a.key < b.key")).filter(_passes(percent, "a", "b")).select(F.col("a.key").alias("u"), F.col("b.key").alias("v")).distinct()
    rest = materialize(rest.join(star, ["u", "v"], "left_anti"), "jaccard-rest")
    discard(sets)
    proposed = rest.select(F.col("u").alias("key")).unionAll(rest.select(F.col("v").alias("key"))).distinct()
    sets = materialize(_sets(docs, names.join(proposed, "key", "left_semi"), k), "jaccard-sets")
    every = materialize(links.unionAll(_verified(rest, sets, percent)), "jaccard-links")
    first, roots = roots, components(every, "jaccard-components")
    discard(posted, star, links, left, rest, sets, every, first)
    return meta.select("doc_id", "n", "key"), roots.select(F.col("node").alias("key"), "root")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_key.

    Documents whose sets of distinct k-word shingles (A-Z lower-cased; fewer words: the whole sequence) have a
    Jaccard similarity of at least percent are linked; component_id is the smallest doc_id reachable. class_key is
    a digest of the set. Null, empty and blank texts have no shingles, are linked with nothing and are their own
    component. Null ids are ignored when the smallest is sought; rows with the same id and different texts are
    different documents; repeated rows are one class; an empty table gives no rows; extra columns are ignored.
    """
    slim = id_and_text(docs, id_col, text_col)
    rows, roots = link_classes(slim, k, percent, chunk)
    some = rows.filter("n > 0")
    classes = some.groupBy("key").agg(F.min("doc_id").alias("own"))
    # smallest ids go from classes to components and back; rows meet their class alone, however large its component
    inside = classes.join(roots, "key")
    least = inside.select("key", "root").join(inside.groupBy("root").agg(F.min("own").alias("least")), "root").select("key", "least")
    named = some.join(classes.join(least, "key", "left"), "key").select("doc_id", "n", F.coalesce("least", "own").alias("component_id"), "key")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "key")
    return named.unionAll(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("class_key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each group of linked documents: that of the smallest id, nulls last.

    Documents without shingles are in no group and all stay; of repeated rows one stays. Rows are told apart by
    their place in the scan, so docs must be a table or another plan that gives its rows in the same order each
    time (the pipeline's stages read Parquet).
    """
    stable_splits(docs.sparkSession)
    rid = F.monotonically_increasing_id()
    slim = docs.select(rid.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, roots = link_classes(slim, k, percent)
    ids = docs.select(rid.alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    placed = rows.filter("n > 0").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).join(ids, "doc_id")
    best = placed.groupBy("root").agg(F.min(F.struct("id", "doc_id")).alias("b"), F.count("*").alias("m")).filter("m > 1")
    gone = materialize(placed.join(best, "root").filter(F.col("doc_id") != F.col("b.doc_id")).select(F.col("doc_id").alias("g")), "jaccard-gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    numbered = docs.select(rid.alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return numbered.join(few, F.col("rid") == F.col("g"), "left_anti").select("row.*")


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
d AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
h AS (SELECT doc_id, g FROM s SEMI JOIN d USING (g)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM h a JOIN h b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
