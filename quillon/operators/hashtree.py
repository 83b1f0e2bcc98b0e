"""Snapshots with a hash tree over key ranges: two of them are compared from the top down, and only the rows of ranges
whose digests differ are read."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.numbers import row_hash
from quillon.operators.dedupe import last_wins
from quillon.operators.diff import snapshot_diff

#: Levels of a tree: 2 ** DEPTH ranges of the keys' hashes are its leaves.
DEPTH = 10


def leaf_of(key: Sequence[str], depth: int = DEPTH) -> Column:
    """The range of a key's hash; the same in every snapshot, so equal rows are in equal leaves."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in key]), 64 - depth).cast("int")


def _tree(rows: DataFrame, columns: Sequence[str], depth: int) -> list[tuple[int, int, int, str]]:
    """(level, node, n_rows, digest) of all nodes that have rows, leaves at level `depth`.

    A leaf's digest is that of sums of its rows' hashes (their order doesn't matter, and tasks sum first); a node's is
    that of its children's, from left to right. Only the leaves' come to the driver, at most 2 ** depth of them.
    """
    h = row_hash(*columns)
    lanes = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)") for i in range(4)]
    leaves = rows.groupBy("leaf_").agg(F.count("*"), F.sha2(F.concat_ws("-", *[x.cast("string") for x in lanes]), 256)).collect()
    now = {r[0]: (r[1], r[2]) for r in leaves}
    out = [(depth, node, *x) for node, x in sorted(now.items())]
    for level in range(depth - 1, -1, -1):
        above: dict[int, tuple[int, str]] = {}
        for node, (n, digest) in sorted(now.items()):
            had, text = above.get(node >> 1, (0, ""))
            above[node >> 1] = (had + n, f"{text},{node}:{digest}")
        now = {node: (n, sha256(text.encode()).hexdigest()) for node, (n, text) in above.items()}
        out += [(level, node, *x) for node, x in sorted(now.items())]
    return out


def write_snapshot(df: DataFrame, key: Sequence[str], path: str, ordinal: str | None = None, volatile: Sequence[str] = (), depth: int = DEPTH) -> None:
    """df below path: rows by leaf, and the tree of their digests over all columns but the volatile ones. Of repeated
    keys the last by `ordinal` is kept (without it they all are)."""
    rows = (last_wins(df, key, ordinal) if ordinal else df).withColumn("leaf_", leaf_of(key, depth))
    rows.repartition("leaf_").write.mode("overwrite").partitionBy("leaf_").parquet(f"{path}/rows")
    columns = [c for c in df.columns if c not in (*volatile, ordinal)]
    df.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    tree = df.sparkSession.createDataFrame(_tree(stored, columns, depth), "level int, node int, n_rows long, digest string")
    tree.coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")


def differing_leaves(spark: SparkSession, old: str, new: str) -> list[int]:
    """Leaves in which two snapshots differ: from the top down, only children of nodes that differ are looked at. The
    trees have at most 2 ** (depth + 1) rows, whatever the snapshots have."""
    a, b = ({(r.level, r.node): r.digest for r in spark.read.parquet(f"{p}/tree").collect()} for p in (old, new))
    depths = {max(level for level, _ in t) for t in (a, b) if t}
    if len(depths) > 1:
        raise ValueError(f"the trees have {sorted(depths)} levels")
    open_ = [0]
    for level in range(max(depths, default=-1) + 1):
        differ = [n for n in open_ if a.get((level, n)) != b.get((level, n))]
        open_ = differ if level == max(depths) else [c for n in differ for c in (2 * n, 2 * n + 1)]
    return open_ if depths else []


def read_leaves(spark: SparkSession, path: str, leaves: Sequence[int]) -> DataFrame:
    """Rows of some leaves of a snapshot: no other folder is listed or read."""
    tree = spark.read.parquet(f"{path}/tree")
    depth = tree.agg(F.max("level")).first()[0]
    there = sorted(r.node for r in tree.filter((F.col("level") == depth) & F.col("node").isin(list(leaves))).select("node").collect()) if leaves else []
    kept = spark.read.parquet(f"{path}/schema")
    return spark.read.schema(kept.schema).parquet(*[f"{path}/rows/leaf_={n}" for n in there]) if there else kept


def tree_diff(spark: SparkSession, old: str, new: str, key: Sequence[str], volatile: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """What snapshot_diff says of two written snapshots, without the rows that are the same: added, removed, changed."""
    leaves = differing_leaves(spark, old, new)
    out = snapshot_diff(*(read_leaves(spark, p, leaves) for p in (old, new)), key, volatile=volatile, label=label)
    return out.filter("change_type <> 'same'")
