"""Chat formatting: collapse of cumulative snapshots, then rendering; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import materialize

#: Turn numbers in a block; a conversation of any length is worked on in blocks of so many turns.
BLOCK = 256
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"
_LANES = ("a", "b", "c", "d")


def _same(left: DataFrame, right: DataFrame, *names: str):
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[n])
    return on


def _plain(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.md5(text).alias("digest"), text.alias("text"))


def prefix_hashes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, blocks): every turn with its place (from 1) and the rolling hash of all turns up to it; no texts.

    A turn's hash covers its place, role and the text's MD5; the rolling hash is the sum of the turns' hashes in
    four 32-bit lanes, so it is formed as a prefix sum: within blocks of turn numbers, and over the blocks' sums. No
    task needs a whole conversation. Equal rows are one turn; rows of one turn number are ordered by role and the
    text's MD5; null turns come first; null roles and texts count as empty; rows with a null conv_id are one
    conversation.
    """
    rows = _plain(conversations).drop("text").distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))).withColumn("rn", F.expr("row_number() over (partition by conv_id, block order by turn, role, digest)"))
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("k")).select(F.col("conv_id").alias("c"), F.col("block").alias("bl"), F.expr("coalesce(sum(k) over (partition by conv_id order by block rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    placed = rows.join(counts, rows.conv_id.eqNullSafe(counts.c) & (rows.block == counts.bl)).withColumn("pos", F.col("before") + F.col("rn")).select("conv_id", "block", "pos", "turn", "role", "digest")
    first, second = F.xxhash64(F.lit("first"), "pos", "role", "digest"), F.xxhash64(F.lit("second"), "pos", "role", "digest")
    low = F.lit((1 << 32) - 1)
    lanes = {"a": first.bitwiseAND(low), "b": F.shiftrightunsigned(first, 32), "c": second.bitwiseAND(low), "d": F.shiftrightunsigned(second, 32)}
    placed = materialize(placed.withColumns(lanes), "chat-turns")
    sums = placed.groupBy("conv_id", "block").agg(F.count("*").alias("k"), *[F.sum(x).alias(x) for x in _LANES])
    over = "over (partition by conv_id order by block rows between unbounded preceding and 1 preceding)"
    blocks = materialize(sums.select("conv_id", "block", F.expr("sum(k) over (partition by conv_id)").alias("n_turns"), *[F.expr(f"coalesce(sum({x}) {over}, 0)").alias(f"{x}0") for x in _LANES], *[F.expr(f"sum({x}) over (partition by conv_id)").alias(f"{x}1") for x in _LANES]), "chat-blocks")
    rolled = placed.withColumns({x: F.expr(f"sum({x}) over (partition by conv_id, block order by pos rows unbounded preceding)") for x in _LANES})
    b = blocks.select(F.col("conv_id").alias("c_"), F.col("block").alias("b_"), "n_turns", *[f"{x}0" for x in _LANES])
    turns = rolled.join(b, rolled.conv_id.eqNullSafe(b.c_) & (rolled.block == b.b_)).select("conv_id", "block", "pos", "turn", "role", "digest", "n_turns", *[(F.col(x) + F.col(f"{x}0")).alias(x) for x in _LANES])
    return turns, blocks


def maximal_conversations(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that are no proper prefix of another.

    Of equal ones the smallest conv_id stays (null only if alone); copies counts them. Every step groups first,
    with partial sums on the map side, so many equal conversations or first turns don't meet in one task.
    """
    whole = blocks.groupBy("conv_id", "n_turns", *[F.col(f"{x}1").alias(x) for x in _LANES]).agg(F.count("*").alias("_"))
    reps = whole.groupBy("n_turns", *_LANES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    longest = turns.groupBy("pos", *_LANES).agg(F.max("n_turns").alias("longest")).filter("longest > pos").select(F.col("pos").alias("n_turns"), *_LANES)
    return reps.join(longest, ["n_turns", *_LANES], "left_anti").select("conv_id", "n_turns", "copies")


def render_maximal(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Rows (conv_id, turn_pos, n_turns, role, segment): the rendered turns of the maximal conversations.

    A conversation's training text is its segments in the order of turn_pos; it is not gathered into one row, as
    one conversation can be of any length. template: with {role} and {text}. An empty table gives no rows; extra
    columns are ignored; for nulls, ties and repeated rows see prefix_hashes.
    """
    turns, blocks = prefix_hashes(conversations)
    turns = materialize(turns, "chat-rolled")
    kept = maximal_conversations(turns, blocks)
    at = kept.join(blocks.select(F.col("conv_id").alias("c_"), F.col("block").alias("b_")), F.col("conv_id").eqNullSafe(F.col("c_"))).select("c_", "b_")
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    wanted = turns.join(at, turns.conv_id.eqNullSafe(at.c_) & (turns.block == at.b_), "left_semi").select(F.col("conv_id").alias("c_"), F.col("turn").alias("t_"), F.col("role").alias("r_"), F.col("digest").alias("d_"), "pos", "n_turns")
    # the texts move once, to meet their places; equal rows become one before
    texts = _plain(conversations).groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"))
    out = texts.join(wanted, texts.conv_id.eqNullSafe(wanted.c_) & texts.turn.eqNullSafe(wanted.t_) & (texts.role == wanted.r_) & (texts.digest == wanted.d_))
    return out.select("conv_id", F.col("pos").alias("turn_pos"), "n_turns", "role", F.concat(F.lit(head), F.col("role"), F.lit(middle), F.col("text"), F.lit(tail)).alias("segment"))


def chat_texts(rendered: DataFrame) -> DataFrame:
    """(conv_id, text): one string a conversation, for conversations known to fit in a row."""
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_pos", "segment"))), lambda x: x["segment"]), "").alias("text"))


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, role, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
        string_agg(len(role) || ':' || len(text) || ':' || role || text, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
whole AS (SELECT n_turns, prefix, min(conv_id) AS conv_id FROM p WHERE pos = n_turns GROUP BY ALL),
kept AS (SELECT conv_id FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos = w.n_turns AND p.n_turns > p.pos AND p.prefix = w.prefix))
SELECT conv_id, pos AS turn_pos, n_turns, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS segment
FROM p WHERE conv_id IN (SELECT conv_id FROM kept)
"""
