"""License scans: phrase places, and diagonal voting against license templates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import batch, bounded_batches, id_and_text, pieces, tidy
from quillon.llm.textwork import WordHashes, utf8, windows

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public license notices by SPDX-like label.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
}
#: Words in a k-gram; how far apart the diagonals of one chain of hits may lie (inserted or left-out words); the share
#: of a template's words that a verified span has, or so many words at least; and the share of the span they make up.
K, GAP, COVERAGE, ENOUGH, DENSITY = 4, 8, 0.6, 24, 0.5
#: Words that make another license of one, besides numbers (versions).
QUALIFIERS = {b"sharealike", b"noncommercial", b"noderivatives", b"noderivs", b"sa", b"nc", b"nd", b"lesser", b"affero", b"alike", b"commercial", b"derivatives"}

#: Bytes that belong to words stay (A-Z as a-z); the others are blanks. UTF-8 keeps non-ASCII characters whole.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORD_BYTES).split()


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after the other, in order."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at, words_before, last = line.find(needle), 0, 0
        while at >= 0:
            words_before += line.count(b" ", last, at)
            out.append((words_before, label))
            last, at = at, line.find(needle, at + 1)
    return sorted(out)


class Templates:
    """Words of templates and all their k-gram hashes in order. Their size is that of a parameter, not of the data."""

    def __init__(self, templates: dict[str, str], k: int):
        self.words = {label: license_words(text) for label, text in templates.items()}
        self.labels, self.k, self.hashes = list(templates), k, WordHashes()
        found = [(h, n, i) for n, label in enumerate(self.labels) for i, h in enumerate(windows(self.hashes.of(self.words[label]), k))]
        found.sort()
        self.h = np.array([h for h, _, _ in found], np.uint64)
        self.at = [(n, i) for _, n, i in found]

    def hits(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """(position in the text, position in the template) of all equal k-grams, by template, in order."""
        grams = windows(self.hashes.of(words), self.k)
        lo, hi = np.searchsorted(self.h, grams, "left"), np.searchsorted(self.h, grams, "right")
        out: dict[int, list] = {}
        for p in np.flatnonzero(hi > lo):
            for n, t in self.at[lo[p] : hi[p]]:
                out.setdefault(n, []).append((int(p), t))
        return {n: sorted(v) for n, v in out.items()}


def chains(hits: list[tuple[int, int]], size: int, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """(first text and template position, last ones) of chains of hits that go up in both, on diagonals at most gap
    apart. Where the template starts again, so does a chain: copies one after the other are spans of their own."""
    open_: list[list[int]] = []
    out = []
    for p, t in hits:
        out += [c for c in open_ if p - c[2] > size + gap]
        open_ = [c for c in open_ if p - c[2] <= size + gap]
        fits = [c for c in open_ if c[2] < p and c[3] < t and abs((p - t) - (c[2] - c[3])) <= gap]
        if fits:
            c = min(fits, key=lambda c: (abs((p - t) - (c[2] - c[3])), p - c[2]))
            c[2:] = p, t
        else:
            open_.append([p, t, p, t])
    return [tuple(c) for c in out + open_]


def aligned(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """(place in a, place in b) of a longest common subsequence."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    n = [[0] * (len(b) + 1)]
    for x in a:
        row, above = [0], n[-1]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        n.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif n[i - 1][j] >= n[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def verified_spans(words: list[bytes], templates: Templates, gap: int, coverage: float, enough: int, density: float) -> list[tuple[str, int, int, int, float]]:
    """(label, start, end, covered, cover) of spans whose words were aligned with a template's.

    Numbers and QUALIFIERS of the template have to be among the aligned words (of a part of a long template, those
    within the part), and the span has no further qualifier. Of overlapping spans of several licenses the one with
    the most words stays.
    """
    found = set()
    for n, hits in templates.hits(words).items():
        label = templates.labels[n]
        want = templates.words[label]
        for p0, t0, p1, t1 in chains(hits, len(want), gap):
            after = len(want) - t1 - templates.k
            lo, hi = max(0, p0 - t0 - min(gap, t0)), p1 + templates.k + after + min(gap, after)
            pairs = aligned(words[lo:hi], want)
            start, end, covered = lo + pairs[0][0], lo + pairs[-1][0] + 1, len(pairs)
            if not (covered >= coverage * len(want) or covered >= enough) or covered < density * (end - start):
                continue
            kept = {want[t] for _, t in pairs}
            part = want[pairs[0][1] : pairs[-1][1] + 1] if covered >= enough else want
            if any(w not in kept for w in part if w in QUALIFIERS or w.isdigit()) or QUALIFIERS & set(words[start:end]) - set(want):
                continue
            found.add((label, start, end, covered, covered / len(want)))
    best: list[tuple[str, int, int, int, float]] = []
    for x in sorted(found, key=lambda x: (-x[3], -x[4], x[0], x[1])):
        if not any(2 * (min(x[2], y[2]) - max(x[1], y[1])) >= x[2] - x[1] and (x[0] == y[0] or family(x[0]) != family(y[0])) for y in best):
            best.append(x)
    return best


def _text_key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K, gap: int = GAP, coverage: float = COVERAGE, enough: int = ENOUGH, density: float = DENSITY, text_col: str = "text") -> DataFrame:
    """(key, label, start, end, covered, cover): verified spans of templates in texts; key is the text's MD5.

    Hits of the rolling k-gram hashes of all words are chained along the diagonals of each template, and the words
    from a chain's template start to its end are aligned with the template's; see verified_spans. Equal texts give
    equal spans once; nulls and texts of fewer than k words give none.
    """
    schema = pa.schema([("key", pa.binary()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("covered", pa.int32()), ("cover", pa.float64())])

    def spans(batches):
        known = Templates(templates, k)
        for b in pieces(batches):
            rows = [(key, *x) for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in verified_spans(license_words(t), known, gap, coverage, enough, density)]
            yield batch(schema, [list(c) for c in zip(*rows)] if rows else [[]] * len(schema))

    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(text_col).cast("string").alias("text")).select(_text_key().alias("key"), "text")
    return slim.mapInArrow(tidy(spans), "key binary, label string, start int, end int, covered int, cover double").distinct()


def family(label: str) -> str:
    """Label without the suffixes that tell templates of one license apart."""
    return label.removesuffix("-line").removesuffix("-text")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, **how) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    base: places of the phrases (first_word, last_word: smallest and largest start, else null); labels: those and
    the ones of verified template spans; score: the largest cover of a span, at least 0.5 with a phrase, else 0.
    Null and empty texts have no words and no labels; null ids stay; repeated rows are scanned each; an empty
    table gives no rows; extra columns are ignored.
    """
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string()))])

    def base(batches):
        for b in pieces(batches):
            rows = []
            for text in b.column(2).to_pylist():
                words = license_words(text)
                at = phrase_places(words, phrases)
                rows.append((len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, sorted({x for _, x in at})))
            yield batch(schema, [b.column(0), b.column(1), *(list(c) for c in zip(*rows))] if rows else [[]] * len(schema))

    slim = id_and_text(docs, id_col, text_col).select(_text_key().alias("key"), "doc_id", "text")
    rows = slim.mapInArrow(tidy(base), "key binary, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    named = F.create_map(*[F.lit(x) for label in templates for x in (label, family(label))])
    spans = license_spans(docs, templates, text_col=text_col, **how).groupBy("key").agg(F.collect_set(named[F.col("label")]).alias("more"), F.max("cover").alias("cover"), F.count("*").alias("n_spans"))
    both = rows.join(spans, "key", "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", none)))), ",").alias("labels"), F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
