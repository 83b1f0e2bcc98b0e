"""Mixing sources to target weights with hash-threshold histograms; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import materialize

WEIGHTS, SHARE, MAX_TIMES = (5, 2, 1), 1.5, 2
#: Bits of a document's hash, and bits that each histogram level resolves (buckets per source: 2 ** STEP).
BITS, STEP = 60, 15
#: Sources up to which the table of thresholds (about 60 bytes a source) is broadcast; beyond, a salted join.
BROADCAST_SOURCES, SALTS = 50_000, 32


def hash_of(id_col: str):
    """60 bits of the id's MD5: the same on every run, machine and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def word_count(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, times: int = MAX_TIMES) -> DataFrame:
    """sizes (source, source_size), one row a source -> also target and whole (how often all of it is taken).

    Sources in code-point order, null last, weigh `weights`, repeating. Together they get share * all sizes by
    weight, none more than times * its own size; what one cannot take goes to the others by weight. The level at
    which this balances is found in closed form over the sources in the order of cap / weight, so it takes one
    sorted pass over one row per source.
    """
    values = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("n", F.expr("row_number() over (order by source asc nulls last)")).withColumn("w", F.element_at(values, ((F.col("n") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(int(times)))
    over = "over (order by cap / w, n rows between unbounded preceding and 1 preceding)"
    levels = ranked.withColumns({"used": F.expr(f"coalesce(sum(cap) {over}, 0)"), "gone": F.expr(f"coalesce(sum(w) {over}, 0)"), "all_w": F.expr("sum(w) over ()"), "budget": F.expr(f"sum(source_size) over () * {float(share)}D")})
    levels = levels.withColumn("level", (F.col("budget") - F.col("used")) / (F.col("all_w") - F.col("gone")))
    levels = levels.withColumn("level", F.expr("max(case when level * w <= cap then level end) over ()"))
    return levels.withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")))).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).select("source", "source_size", "target", F.col("whole").cast("long"))


def _thresholds(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with cut: the rest of the target beyond whole rounds is met by the documents with hash < cut."""
    open_ = materialize(goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), "mix-level")
    found = None
    for shift in range(BITS - STEP, -1, -STEP):
        few = open_.select(F.col("source").alias("s"), "rest", "prefix", "below")
        inside = (sized if shift == BITS - STEP else _by_source(sized, few, F.shiftright(F.col("h"), shift + STEP) == F.col("prefix")).select(*sized.columns)).groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("t"))
        met = inside.join(few, inside.source.eqNullSafe(few.s)).withColumn("upto", F.col("below") + F.expr("sum(t) over (partition by source order by bucket rows unbounded preceding)"))
        first = met.filter("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", "rest", "upto", "t")).alias("x")).select("source", "x.rest", F.col("x.bucket").alias("prefix"), (F.col("x.upto") - F.col("x.t")).alias("below"), "x.t")
        found = open_ = materialize(first, "mix-level")
    # a bucket is one hash value now; its documents go in if that comes nearer to the target
    near = (F.col("below") + F.col("t") - F.col("rest")) < (F.col("rest") - F.col("below"))
    cuts = found.select(F.col("source").alias("s"), (F.col("prefix") + near.cast("long")).alias("cut"))
    return goal.join(cuts, goal.source.eqNullSafe(cuts.s), "left").select(goal["*"], F.coalesce("cut", F.lit(0)).alias("cut"))


def _by_source(sized: DataFrame, few: DataFrame, *conditions) -> DataFrame:
    """sized joined with a table of one row a source (its column s); a source may hold most rows.

    The table is broadcast if its size was checked; beyond, it is repeated for every salt of the documents' hash,
    so that the rows of one source spread over many tasks.
    """
    if few.count() <= BROADCAST_SOURCES:
        on = sized.source.eqNullSafe(few.s)
        few = F.broadcast(few)
    else:
        few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = sized.source.eqNullSafe(few.s) & (F.pmod(sized.h, F.lit(SALTS)).cast("int") == few.salt)
    for c in conditions:
        on = on & c
    return sized.join(few, on)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, times: int = MAX_TIMES) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, times (copies taken), taken = times * size.

    size counts the words of the text. Histograms of (source, hash bucket) are summed first; the bucket in which a
    source's budget ends is refined level by level until it is one hash value, and a filter on the hash follows;
    nothing is sorted by document. Each source's taken words differ from its target by half the words of one hash
    value at most. Null and empty texts have size 0; a null source is a source; null ids share one hash, and so do
    rows of one id: they are taken or left together; an empty table gives no rows; extra columns are ignored.
    """
    sized = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), hash_of(id_col).alias("h")), "mix-sizes")
    goal = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, times), "mix-goal")
    cuts = materialize(_thresholds(sized, goal), "mix-cuts").withColumnRenamed("source", "s")
    copies = F.col("whole") + (F.col("h") < F.col("cut")).cast("long")
    return _by_source(sized, cuts).select("doc_id", "source", "size", "source_size", "target", copies.alias("times"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, times: int = MAX_TIMES) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as it is taken.

    The thresholds of mix_sources are applied to the rows' own hashes, so the documents are neither joined by id
    nor moved. Same results for nulls, ties and repeated rows.
    """
    sized = materialize(docs.select(F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), hash_of(id_col).alias("h")), "mix-sizes")
    goal = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, times), "mix-goal")
    cuts = materialize(_thresholds(sized, goal).select(F.col("source").alias("s"), "whole", "cut"), "mix-cuts")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source_col).cast("string").alias("source"), hash_of(id_col).alias("h"))
    copies = (F.col("whole") + (F.col("h") < F.col("cut")).cast("long")).cast("int")
    taken = _by_source(rows, cuts).filter(copies > 0)
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select("row.*")
