"""Spelling variants: permuterm rotations of a corpus's words, neighbours one edit apart, and the form they lead to."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import batch, discard, id_and_text, materialize, pieces, tidy

#: Code points and occurrences a word has at least, how many times as frequent a form is, and which runs lose a letter.
LENGTH, OCCURRENCES, TIMES, EVERY = 5, 3, 2, 97
#: Words a task counts before it hands its sums on.
HELD = 200_000
#: End of a word in its rotations; no letter of a word.
END = "$"

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def read_runs(doc_id: int | None, text: str | None) -> Counter:
    """Words of a text with their number: runs of letters, A-Z as a-z; of a run whose CRC-32 with the id is divisible
    by EVERY, one letter is left out. A null id is read as an empty one."""
    out: Counter = Counter()
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall((text or "").translate(_LOWER))).items():
        h = crc32(run.encode(), seed)
        if h % EVERY == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        out[run] += n
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of all words of at least `length` code points that occur often enough; summed in tasks first."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        held: Counter = Counter()
        for b in pieces(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in read_runs(doc_id, text).items():
                    if len(word) >= length:
                        held[word] += n
            if len(held) >= HELD:
                yield batch(schema, [list(held), list(held.values())])
                held.clear()
        yield batch(schema, [list(held), list(held.values())])

    sums = id_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "word string, n long")
    return sums.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, counts, word, n) of all rotations of the words with END: of word w, w[i:] + END + w[:i].

    A rotation stands under its own text, which the words with one letter more reach as a prefix (skipped is null),
    and under all but its last letter, the edited one that the prefix skips. `counts` is false for a letter like the
    one before it in the word: leaving out either gives the same shorter word, which so is reached once.
    """
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    tail, head = F.expr("substring(word, i + 1)"), F.expr("substring(word, 1, i)")
    whole = at.select(F.concat(tail, F.lit(END), head).alias("prefix"), F.lit(None).cast("string").alias("skipped"), F.lit(True).alias("counts"), "word", "n")
    letter, before = F.expr("substring(word, i, 1)"), F.when(F.col("i") > 1, F.expr("substring(word, i - 1, 1)")).otherwise("")
    skipping = at.filter("i > 0").select(F.concat(tail, F.lit(END), F.expr("substring(word, 1, i - 1)")).alias("prefix"), letter.alias("skipped"), (letter != before).alias("counts"), "word", "n")
    return whole.unionAll(skipping)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that are one inserted, deleted or replaced letter from others.

    The rotations are dealt by prefix and sorted, so each range of equal prefixes lies together, and are scanned: the
    words that skip a letter in a range are replacements of each other (no more than letters exist), and insertions
    of the one word that ends there. A pair of words has one range in common, so sums over ranges count it once.
    """
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def emit(shorter, longer, out):
        """Neighbours within a range: shorter is (n, word) or None, longer a list of (n, word, counts)."""
        top = sorted(longer, key=lambda x: (-x[0], x[1]))[:2]
        for n, word, counts in longer:
            near = [x[:2] for x in top if x[1] != word][:1] + ([shorter] if shorter and counts else [])
            if near:
                best = min(near, key=lambda x: (-x[0], x[1]))
                out.append((word, len(longer) - 1 + (1 if shorter and counts else 0), *best))
        inserted = [x for x in longer if x[2]]
        if shorter and inserted:
            best = min(inserted, key=lambda x: (-x[0], x[1]))
            out.append((shorter[1], len(inserted), best[0], best[1]))

    def run(batches):
        prefix, shorter, longer = None, None, []
        for b in pieces(batches, 5000):
            out: list = []
            for p, skipped, counts, word, n in zip(*(c.to_pylist() for c in b.columns)):
                if p != prefix:
                    emit(shorter, longer, out)
                    prefix, shorter, longer = p, None, []
                if skipped is None:
                    shorter = (n, word)
                else:
                    longer.append((n, word, counts))
            yield batch(schema, [list(c) for c in zip(*out)] if out else [[]] * 4)
        out = []
        emit(shorter, longer, out)
        yield batch(schema, [list(c) for c in zip(*out)] if out else [[]] * 4)

    ranges = rotations(words).repartition("prefix").sortWithinPartitions("prefix")
    found = ranges.mapInArrow(tidy(run), "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.less")).alias("best_n"), F.col("x.word").alias("best"))


def follow(forms: DataFrame, name: str = "variant-roots") -> DataFrame:
    """(word, root) of a table (word, form) in which forms have no cycle and no null: the last form from word on.

    Pointers are doubled, so a chain of k forms takes about log2(k) rounds; each is written to the shared folder.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), name)
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        last, now = now, materialize(now.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), name)
        discard(last)
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES, times: int = TIMES) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n (the most frequent near word, if it is `times` as frequent;
    ties: the smallest by code points), root (the last form from the word on, or the word).

    Null and empty texts have no words; a null id is an empty one; repeated rows count each; texts are read whole; an
    empty table gives no rows; extra columns are ignored.
    """
    words = materialize(count_words(docs, id_col, text_col, length, occurrences), "variant-words")
    near = neighbours(words).withColumnRenamed("word", "w")
    formed = F.col("best_n") >= F.col("n") * F.lit(times)
    rows = materialize(words.join(near, F.col("word") == F.col("w"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "variants")
    roots = follow(rows.filter("form is not null")).withColumnRenamed("word", "w")
    return rows.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same by SQL: words one edit apart share what is left when a letter at the same place is left out.
ORACLE_SQL = """
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
own AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs GROUP BY doc_id, run),
steps AS (SELECT run, c, flatten([[4294967295::BIGINT], flatten(list_transform(range(0, len(hx) // 2), lambda i: [('0x' || substr(hx, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]) AS s FROM own),
crc AS (SELECT run, c, xor(list_reduce(s, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) AS h FROM steps),
said AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM crc),
v AS (SELECT word, sum(c)::BIGINT AS n FROM said WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
top AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS best, max(other_n) AS best_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN top ON top.word = v.word),
r AS (SELECT word, word AS root, form FROM f UNION ALL SELECT r.word, r.form, f.form FROM r JOIN f ON f.word = r.form WHERE r.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL
"""
