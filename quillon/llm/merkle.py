"""Merkle dataset manifest: leaves in aligned blocks, witnesses that grow as sibling subtrees complete."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import batch, bounded_batches, discard, materialize, pieces, tidy

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block has 2 ** BLOCK nodes: what one task appends to one open tree, whatever the size of a group.
BLOCK = 10


def parent(*digests: bytes) -> bytes:
    """Digest of the run's digests, joined as hex text; one alone has a parent too."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


class OpenTree:
    """Leaves appended one by one. Complete subtrees wait for the sibling on their right; each leaf has the witness
    (siblings so far, lowest first) that leads to the top of the subtree it is in."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int]] = []  # height, digest, first leaf
        self.witness: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        self.open.append((0, digest, len(self.witness)))
        self.witness.append(bytearray())
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._join()

    def _join(self) -> None:
        """The two last subtrees become one, and the witnesses below each get the other's digest."""
        height, right, middle = self.open.pop()
        _, left, first = self.open.pop()
        for w in self.witness[first:middle]:
            w += right
        for w in self.witness[middle:]:
            w += left
        self.open.append((height + 1, parent(left, right), first))

    def close(self, height: int) -> bytes:
        """Digest at the given height; a subtree without a sibling goes up alone and lengthens no witness."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
                self._join()
            else:
                level, digest, first = self.open.pop()
                self.open.append((level + 1, parent(digest), first))
        return self.open[0][1]


def fold(digest: bytes, place: int, size: int, siblings: Sequence[bytes]) -> tuple[bytes, int]:
    """(digest at the top of a tree of `size` leaves, siblings used) from the leaf at `place` upwards."""
    used = 0
    while size > 1:
        if place ^ 1 < size:
            other, used = siblings[used], used + 1
            digest = parent(digest, other) if place % 2 == 0 else parent(other, digest)
        else:
            digest = parent(digest)
        place, size = place >> 1, (size + 1) >> 1
    return digest, used


def encoded(value):
    """A value of a leaf: - if null, else the number of its bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence):
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", tampered: str = "n_chars", every: int = 7) -> DataFrame:
    """(g, doc_id, h, other): a row's group, id and leaf, and the leaf after tampering where the row is tampered with,
    else null: one is added to a column where `every` divides the unsigned CRC-32 of the decimal id (null: never)."""
    values = [F.col(f"`{c}`") for c in fields]
    more = [(v.cast("decimal(20,0)") + 1) if c == tampered else v for v, c in zip(values, fields, strict=True)]
    hit = (F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % every == 0) & F.col(f"`{tampered}`").isNotNull()
    return docs.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).cast("long").alias("doc_id"), leaf_digest(values).alias("h"), F.when(hit, leaf_digest(more)).alias("other"))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows with pos (place in its group g by `order`, nulls first) and n (rows of the group), both from written runs.

    Rows are dealt by ranges and sorted there; a group of any size is spread over many tasks, and so are equal rows,
    which can change places. Places come from the rows' number in their task and the number of the group's rows in
    the tasks before: a table of one row a task and group.
    """
    keys = ["g", *order, "split"]
    dealt = rows.withColumn("split", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("split")
    placed = materialize(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    runs = placed.groupBy(F.col("g").alias("run_g"), F.col("part").alias("run_part")).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    runs = runs.withColumns({"before": F.expr("coalesce(sum(c) over (partition by run_g order by run_part rows between unbounded preceding and 1 preceding), 0)"), "n": F.expr("sum(c) over (partition by run_g)")})
    out = placed.join(runs, placed.g.eqNullSafe(runs.run_g) & (placed.part == runs.run_part)).withColumn("pos", F.col("before") + F.col("at") - F.col("first"))
    out = out.drop("run_g", "run_part", "part", "at", "first", "c", "before")
    out.materialized_at = placed.materialized_at
    return out


def append_blocks(nodes: DataFrame, name: str) -> DataFrame:
    """nodes (g, pos, n, h, ...) with block, w (witness inside the block) and block_root (on a block's first row)."""
    rows = nodes.withColumn("block", F.shiftright("pos", BLOCK))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree = OpenTree()
        for h in table.column("h").to_pylist():
            tree.append(h)
        root = tree.close(min(BLOCK, (table.column("n")[0].as_py() - 1).bit_length()))
        return table.append_column("w", pa.array([bytes(w) for w in tree.witness], pa.binary())).append_column("block_root", pa.array([root] + [None] * (table.num_rows - 1), pa.binary()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return materialize(rows.groupBy("g", "block").applyInArrow(run, f"{kinds}, w binary, block_root binary"), name)


def block_roots(local: DataFrame) -> DataFrame:
    """The blocks of append_blocks as nodes of a further tree, in which they are appended in turn."""
    return local.filter("block_root is not null").select("g", F.col("block").alias("pos"), F.shiftright(F.col("n") + ((1 << BLOCK) - 1), BLOCK).alias("n"), F.col("block_root").alias("h"))


def witnesses(nodes: DataFrame, most: int, name: str) -> DataFrame:
    """nodes (g, pos, n, h, ...) with w, the siblings up to the group's top, and top; no group has more than `most`
    nodes. Block roots are appended to a tree of blocks, whose witnesses extend those of the blocks' nodes."""
    local = append_blocks(nodes, name)
    if most <= 1 << BLOCK:
        roots = local.filter("block_root is not null").select(F.col("g").alias("up_g"), F.col("block_root").alias("top"))
        return local.join(roots, local.g.eqNullSafe(roots.up_g)).drop("up_g", "block", "block_root")
    return extend(local, witnesses(block_roots(local), -(-most >> BLOCK), name))


def extend(local: DataFrame, above: DataFrame) -> DataFrame:
    """Rows of append_blocks with the witnesses of their blocks added; a block has 2 ** BLOCK rows at most."""
    kept = [c for c in local.columns if c not in ("w", "block_root", "block")]
    up = above.select(F.col("g").alias("up_g"), F.col("pos").alias("up_pos"), F.col("w").alias("up_w"), *[c for c in above.columns if c not in ("g", "pos", "n", "h", "w")])
    out = local.join(up, local.g.eqNullSafe(up.up_g) & (local.block == up.up_pos))
    return out.select(*kept, F.concat("w", "up_w").alias("w"), *[c for c in up.columns if not c.startswith("up_")])


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, h (leaf), other (leaf after tampering, else null), pos and n (place and number
    of leaves in the group), g_pos and g_n (those of the group among groups), top (subroot), root, w (witness: all
    siblings' digests, 32 bytes each, from the leaf's to those of the subroot).

    Per group, leaves ascend by id (null first; rows of one id by leaf); groups ascend by bytes, null first. Each
    level joins two consecutive nodes, and a last one alone has a parent of its own. Null, empty and very long values
    are told apart by their lengths; repeated rows are leaves each; extra columns are ignored; an empty table gives
    no rows.
    """
    bounded_batches(docs.sparkSession)
    made = materialize(leaves(docs, fields, id_col, group_col), "merkle-leaves")
    placed = numbered(made, ("doc_id", "h"), "merkle-order")
    local = append_blocks(placed, "merkle-blocks")
    discard(made, placed)
    blocks = block_roots(local)
    above = materialize(witnesses(blocks, blocks.agg(F.max("n")).first()[0] or 0, "merkle-tree"), "merkle-tree")
    groups = numbered(above.filter("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("h")), ("name",), "merkle-groups")
    crown = witnesses(groups, groups.count(), "merkle-crown").select("name", F.col("pos").alias("g_pos"), F.col("n").alias("g_n"), F.col("w").alias("g_w"), F.col("top").alias("root"))
    whole = above.join(crown, above.g.eqNullSafe(crown.name)).withColumn("w", F.concat("w", "g_w")).drop("name", "g_w")
    return extend(local, whole)


def verify_manifest(manifest: DataFrame) -> DataFrame:
    """One row per row of merkle_manifest: doc_id, leaf, subroot, root, proof_sha256 (of the witness as hex text),
    folded_root (from the tampered leaf, where there is one, and the witness) and verified (it equals root)."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

    def run(batches):
        for b in pieces(batches, 2000):
            rows = []
            for doc, h, other, pos, n, g_pos, g_n, w, top, root in zip(*(c.to_pylist() for c in b.columns)):
                siblings = [w[i : i + 32] for i in range(0, len(w), 32)]
                middle, used = fold(other or h, pos, n, siblings)
                folded, _ = fold(middle, g_pos, g_n, siblings[used:])
                rows.append((doc, h.hex(), top.hex(), root.hex(), sha256(w.hex().encode()).hexdigest(), folded.hex(), folded == root))
            yield batch(schema, [list(c) for c in zip(*rows)] if rows else [[]] * len(schema))

    slim = manifest.select("doc_id", "h", "other", "pos", "n", "g_pos", "g_n", "w", "top", "root")
    return slim.mapInArrow(tidy(run), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


#: The same manifest by SQL: trees level by level, then each leaf's way up with its siblings.
ORACLE_SQL = """
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS rid, doc_id, lang, n_chars, source, text FROM documents),
bytes AS (SELECT rid, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT) AS b FROM raw WHERE doc_id IS NOT NULL),
crc AS (SELECT rid, xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(b, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))]),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) AS crc FROM bytes),
f AS (SELECT r.*, crc % 7 = 0 AND n_chars IS NOT NULL AS hit,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail FROM raw r LEFT JOIN crc USING (rid)),
d AS (SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN hit THEN sha256(head || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1)::VARCHAR || tail) END AS other FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (SELECT lang, 0 AS level, pos, n, leaf AS h FROM o
  UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos, n, subroot AS h FROM subs
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
up AS (SELECT rid, lang, 0 AS level, pos, n, coalesce(other, leaf) AS h, '' AS proof FROM o
  UNION ALL SELECT u.rid, u.lang, u.level + 1, u.pos // 2, (u.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN u.h WHEN u.pos % 2 = 0 THEN u.h || s.h ELSE s.h || u.h END), u.proof || coalesce(s.h, '')
  FROM up u LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM u.lang AND s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1),
over AS (SELECT u.rid, 0 AS level, s.pos, s.n, u.h, u.proof FROM up u JOIN subs s ON s.lang IS NOT DISTINCT FROM u.lang WHERE u.n = 1
  UNION ALL SELECT u.rid, u.level + 1, u.pos // 2, (u.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN u.h WHEN u.pos % 2 = 0 THEN u.h || s.h ELSE s.h || u.h END), u.proof || coalesce(s.h, '')
  FROM over u LEFT JOIN tops s ON s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1)
SELECT o.doc_id, o.leaf, s.subroot, t.h AS root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = t.h AS verified
FROM o JOIN subs s ON s.lang IS NOT DISTINCT FROM o.lang JOIN over v ON v.rid = o.rid AND v.n = 1 JOIN tops t ON t.n = 1
"""
