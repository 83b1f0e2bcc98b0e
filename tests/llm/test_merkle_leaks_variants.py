"""Merkle manifest, decontamination and spelling variants against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import decontamination, merkle, variants
from tests.llm.cases import awkward, clashing, empty


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, more=0):
    values = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    """All levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way_up(tree, i, now):
    """(digest at the top from `now` at place i, siblings)."""
    siblings = []
    for nodes in tree[:-1]:
        if i ^ 1 < len(nodes):
            siblings.append(nodes[i ^ 1])
            now = sha(now + nodes[i ^ 1] if i % 2 == 0 else nodes[i ^ 1] + now)
        else:
            now = sha(now)
        i //= 2
    return now, siblings


def brute_manifest(df):
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    crown = levels([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            a, s = way_up(trees[g], i, leaf(r, 1) if hit else own)
            b, t = way_up(crown, place, a)
            out.append((r.doc_id, own, trees[g][-1][0], crown[-1][0], sha("".join(s + t)), b, b == crown[-1][0]))
    return sorted(out, key=repr)


def manifest(df):
    return merkle.verify_manifest(merkle.merkle_manifest(df))


def test_manifest_of_awkward_rows(spark):
    df = awkward(spark)
    assert rows_of(manifest(df)) == brute_manifest(df)
    assert rows_of(manifest(clashing(df))) == brute_manifest(df)
    assert manifest(empty(spark)).count() == 0
    one = df.filter("doc_id = 4")
    (r,) = manifest(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")


@pytest.mark.parametrize("block", [1, 2, 10])
def test_manifest_of_many_sizes_and_blocks(spark, monkeypatch, block):
    """Groups of 1 to 40 leaves, a hot one, repeated rows; blocks of 2, 4 and 1,024 nodes give the same trees."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = [(i % 211, f"text {i % 23}", None if n == 9 else f"l{n}", "s", i) for n, size in enumerate([1, 2, 3, 5, 8, 13, 21, 40, 4, 300]) for i in range(size)]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert rows_of(manifest(df)) == brute_manifest(df)


def test_tampering_is_found_only_where_it_happened(spark):
    df = awkward(spark)
    for r in manifest(df).collect():
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.verified != (hit and any(x.doc_id == r.doc_id and x.n_chars is not None for x in df.collect()))
    top = spark.createDataFrame([(i, "x", "en", "a", (1 << 63) - 1) for i in range(20)], df.schema)
    assert {r.verified for r in manifest(top).collect()} == {True, False}  # the largest long can be added to


def test_open_tree_and_fold_agree():
    for size in range(1, 40):
        tree, leaves = merkle.OpenTree(), [hashlib.sha256(bytes([i])).digest() for i in range(size)]
        for x in leaves:
            tree.append(x)
        root = tree.close((size - 1).bit_length())
        assert root.hex() == levels([x.hex() for x in leaves])[-1][0]
        for i, x in enumerate(leaves):
            w = bytes(tree.witness[i])
            siblings = [w[k : k + 32] for k in range(0, len(w), 32)]
            assert merkle.fold(x, i, size, siblings) == (root, len(siblings))


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_contamination(docs, items, size=10):
    found = defaultdict(set)
    for r in items:
        words = WORD.findall(lower(r.text))
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            found[tuple(words[i : i + n])].add(r.item_id)
    out = []
    for r in docs:
        words, hit, who = WORD.findall(lower(r.text)), set(), set()
        for window, owners in found.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    who |= {str(x) for x in owners if x is not None}
        out.append((r.doc_id, len(words), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaky(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "eps"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 5, 10, 11, 12, 15, 4, 10])] + [(10, None), (11, ""), (12, "!?"), (3, text(11)), (None, text(6))]
    docs = [(i, text(rng.randrange(0, 120)), "en", "s", 1) for i in range(40)] + [(100 + (i or 50), (t or "").upper() + " tail " + (t or ""), "en", "s", 1) for i, t in items]
    docs += docs[-3:]
    return spark.createDataFrame(docs, empty(spark).schema), spark.createDataFrame(items, "item_id long, text string")


def test_contamination_against_brute_force(spark):
    docs, items = leaky(spark)
    docs = docs.unionAll(awkward(spark))
    want = brute_contamination(docs.collect(), items.collect())
    assert sum(r[-1] for r in want) > 20
    for df in (docs, clashing(docs)):
        assert rows_of(decontamination.contamination(df, items)) == want
    assert rows_of(decontamination.contamination(docs, items, broadcast_bytes=0)) == want  # through the sieve and a join
    assert rows_of(decontamination.contamination(docs, clashing(items.withColumns({"doc_id": F.lit(1), "lang": F.lit("x")})))) == want
    assert rows_of(decontamination.contamination(docs, items, size=3)) == brute_contamination(docs.collect(), items.collect(), 3)


def test_contamination_of_empty_tables(spark):
    docs, items = leaky(spark)
    for how in ({}, {"broadcast_bytes": -1}):
        assert decontamination.contamination(empty(spark), items, **how).count() == 0
        none = decontamination.contamination(docs, items.limit(0), **how)
        assert none.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0 and none.count() == docs.count()


def test_removal_of_spans_and_documents(spark):
    passage = " ".join(f"secret{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = clashing(spark.createDataFrame([(1, f"Before it, ({passage.upper()}). After: é.", "en", "a", 1), (2, "clean words only", "en", "a", 1), (3, passage, None, None, None), (4, None, "en", "a", 1), (5, passage + " " + "w " * 88, "en", "a", 1)], empty(spark).schema))
    for how in ({}, {"broadcast_bytes": 0}):
        cut = decontamination.decontaminate(docs, items, **how)
        assert cut.columns == docs.columns
        assert {r.doc_id: r.text for r in cut.collect()} == {1: "Before it, (After: é.", 2: "clean words only", 4: None, 5: "w " * 88}
        assert {r.doc_id for r in decontamination.decontaminate(docs, items, "documents", **how).collect()} == {2, 4}
        assert {r.doc_id for r in decontamination.decontaminate(docs, items, "documents", 0.2, **how).collect()} == {2, 4, 5}
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, "lines")


def test_merged_places():
    assert decontamination.merged([(5, 9), (0, 2), (2, 4), (6, 7)]) == [{"start": 0, "end": 4}, {"start": 5, "end": 9}]


# --- spelling variants


def brute_words(docs):
    n = defaultdict(int)
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_variants_against_brute_force(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(4, 8))) for _ in range(250)} | {"aaaaa", "aaaaaa", "aaaaaaa", "straße", "stra×e"})
    texts = [(i % 50 if i % 9 else None, " ".join(rng.choices(words, [1 / (1 + i % 17) ** 2 for i in range(len(words))], k=60)).title() + "1x2", "en", "s", 1) for i in range(120)]
    docs = spark.createDataFrame(texts, empty(spark).schema).unionAll(awkward(spark))
    n = brute_words(docs.collect())
    want = brute_variants(n)
    assert sum(r[1] is not None for r in want) > 10 and max(r[4] for r in want) > 4
    assert rows_of(variants.spelling_variants(docs)) == want
    assert rows_of(variants.spelling_variants(clashing(docs).repartition(3))) == want


def test_chains_of_forms_end_at_their_roots(spark):
    """Each word twice as frequent as the one before, one letter apart: a chain, a tie, and a word alone."""
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbc"]
    docs = [(None, " ".join([w] * (3 << i)), "en", "s", 1) for i, w in enumerate(chain)] + [(None, "zzzzx zzzzx zzzzx zzzzx zzzzx zzzzx zzzzw zzzzw zzzzw zzzzw zzzzw zzzzw zzzzz zzzzz zzzzz lonely lonely lonely", "en", "s", 1)]
    df = spark.createDataFrame(docs, empty(spark).schema)
    n = brute_words(df.collect())
    assert rows_of(variants.spelling_variants(df)) == brute_variants(n)
    got = {r.word: r for r in variants.spelling_variants(df).collect()}
    assert {got[w].root for w in chain if w in got} == {"bbbbbc"} and got["zzzzz"].form == "zzzzw" and got["lonely"].n_near == 0


def test_variants_of_no_words(spark):
    assert variants.spelling_variants(empty(spark)).count() == 0
    assert variants.spelling_variants(awkward(spark).filter("text is null")).count() == 0


def test_long_text_is_counted_whole(spark):
    df = spark.createDataFrame([(1, "wörter " * 200_000, "de", "s", 1)], empty(spark).schema)
    (r,) = variants.spelling_variants(df).collect()
    assert (r.n, r.n_near, r.form, r.root) == (200_000, 0, None, r.word)
