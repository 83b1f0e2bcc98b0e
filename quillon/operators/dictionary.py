"""Dictionaries of any size over texts: one automaton a pass instead of one pattern an alias."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.batch import bounded_batches
from quillon.functions.text import _c
from quillon.sources.shared import materialize

#: Bytes of aliases and values that one automaton holds, counted before it is broadcast; more aliases take more passes.
AUTOMATON_BYTES = 32 << 20
#: Characters of texts whose matches a worker holds at once, a longer text being alone; bounds memory, not results.
PIECE = 1 << 18
#: Characters that make a longer word of an alias they touch.
LETTERS = "abcdefghijklmnopqrstuvwxyz"

MATCH = "array<struct<start: int, alias: string, value: string>>"
_BUILT: dict = {}


def _automaton(shared):
    """The automaton of a broadcast list of (alias, values), built once a worker, with arrow arrays of the alias and
    the value of every entry: entries are numbered so that those of one alias follow each other by value."""
    key = shared.value[0]
    if key not in _BUILT:
        import ahocorasick

        a, aliases, values = ahocorasick.Automaton(), [], []
        for alias, own in shared.value[1]:
            a.add_word(alias, (len(alias), len(values), len(own)))
            aliases += [alias] * len(own)
            values += sorted(own)
        a.make_automaton()
        _BUILT.clear()
        _BUILT[key] = a, pa.array(aliases, pa.string()), pa.array(values, pa.string()), np.array([len(x) for x in aliases], np.int32)
    return _BUILT[key]


def _found(built, texts: list[str | None], letters: frozenset) -> pa.Array:
    """Matches of each text, as numbers until they are one array: a text may have as many as words."""
    automaton, aliases, values, lengths = built
    starts, entries, ends = array("i"), array("i"), [0]
    for text in texts:
        if text and len(automaton):
            for end, (length, entry, n) in automaton.iter(text):
                start = end + 1 - length
                if (not start or text[start - 1] not in letters) and (end + 1 == len(text) or text[end + 1] not in letters):
                    for e in range(entry, entry + n):
                        starts.append(start)
                        entries.append(e)
        ends.append(len(starts))
    at, entry = np.frombuffer(starts, np.int32), np.frombuffer(entries, np.int32)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    order = np.lexsort((entry, -lengths[entry], at, row)) if len(at) else np.empty(0, np.int64)
    entry = pa.array(entry[order])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(at[order]), aliases.take(entry), values.take(entry)], ["start", "alias", "value"]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches and the texts of their last column, of PIECE characters at most or of one row."""
    for b in batches:
        at, n, held = 0, 0, []
        for i in range(b.num_rows):
            text = b.column(b.num_columns - 1)[i].as_py()
            if held and n + len(text or "") > PIECE:
                yield b.slice(at, len(held)), held
                at, n, held = i, 0, []
            held.append(text)
            n += len(text or "")
        if held:
            yield b.slice(at, len(held)), held


def dictionary_matches(df: DataFrame, text: str, aliases: DataFrame, alias: str = "alias", value: str = "value", letters: str = LETTERS, automaton_bytes: int = AUTOMATON_BYTES, name: str = "matches") -> DataFrame:
    """df with an array of struct(start, alias, value): all places in the lower-cased text at which an alias stands that
    no letter touches, by place, the longest first.

    Aliases are lower-cased; empty and null ones are left out, and several values of one come as several matches. The
    dictionary is cut by a hash of the alias into parts that fit the bound, each a pass over the texts in linear time,
    so any number of aliases makes the same plan. Null texts have no matches; texts are read whole, a few at a time: a
    worker's memory follows the longest text and not the table.
    """
    import uuid

    spark = df.sparkSession
    bounded_batches(spark)
    words = aliases.select(F.lower(F.col(alias)).alias("a"), F.col(value).cast("string").alias("v")).filter("a is not null and a <> ''").groupBy("a").agg(F.array_sort(F.collect_set("v")).alias("v"))
    words = materialize(words, "dictionary")
    size = words.agg(F.sum(F.octet_length("a") + 16 + F.aggregate("v", F.lit(0), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    parts = max(1, -(-size // automaton_bytes))
    out = df
    arrays = []
    for n in range(parts):
        rows = words.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == n).collect()
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.a, list(r.v)) for r in rows]))
        kept = frozenset(letters)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            built = _automaton(shared)
            for b, texts in _pieces(batches):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _found(built, texts, kept)], names=[*b.schema.names[:-1], "m"])

        arrays.append(f"m{n}_")
        row = out.select(F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("row"), F.lower(F.col(f"`{text}`")).alias("t"))
        out = row.mapInArrow(run, f"row {row.schema['row'].dataType.simpleString()}, m {MATCH}").select("row.*", F.col("m").alias(arrays[-1]))
    by_place = F.array_sort(F.concat(*arrays), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).when(F.length(a["alias"]) != F.length(b["alias"]), F.signum(F.length(b["alias"]) - F.length(a["alias"]))).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0).cast("int")) if parts > 1 else F.col(arrays[0])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], by_place.alias(name))


def values_of(matches) -> Column:
    """Distinct values in the order of their first places."""
    return F.array_distinct(F.transform(_c(matches), lambda m: m["value"]))


def longest_value(matches) -> Column:
    """Value of the longest alias that matched (ties: the smallest alias, then value); null without matches."""
    order = F.array_sort(F.transform(_c(matches), lambda m: F.struct((-F.length(m["alias"])).alias("n"), m["alias"].alias("a"), m["value"].alias("v"))))
    return F.get(order, F.lit(0))["v"]


def without_overlaps(matches) -> Column:
    """Matches from the left, the longest at each place, none that starts within the one before."""
    start = F.struct(F.array().cast(MATCH).alias("kept"), F.lit(0).alias("upto"))
    more = lambda s, m: F.struct(F.concat(s["kept"], F.array(m)).alias("kept"), (m["start"] + F.length(m["alias"])).alias("upto"))
    return F.aggregate(_c(matches), start, lambda s, m: F.when(m["start"] >= s["upto"], more(s, m)).otherwise(s), lambda s: s["kept"])
