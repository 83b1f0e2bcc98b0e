"""Every stage of the pipeline on the awkward cases, with expected values computed by hand."""

import itertools
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quillon.llm.shared import materialize
from tests.llm.cases import DDL, PROSE, awkward, clashing, empty
from tests.llm.test_media_quality_licenses import brute_quality
from tests.llm.test_pairs_mix_chat_html import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    """Rows of the columns of documents, as often as they occur."""
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def size(text):
    return len(WORD.findall(text or ""))


def docs(spark):
    """Awkward rows, repeated ones, null ids with and without text, null sources, ties and one very long text."""
    more = [(20 + i, f"{PROSE} number {i} of many words that differ {i * 7}", "en", "hot", 1) for i in range(30)]
    more += [(None, f"{PROSE} without an id {i}", "en", None, 1) for i in range(6)] + [(40, "a b c d e f g h", "en", "tiny", 8)] * 3
    more += [(50, " ".join(f"long{i % 5003}w{i % 17}" for i in range(60_000)), "en", "c", 1)]
    return awkward(spark).unionAll(spark.createDataFrame(more, DDL))


@pytest.mark.parametrize("wrap", [lambda df: df, clashing])
def test_quality_keeps_what_the_rules_keep(spark, wrap):
    df = wrap(docs(spark))
    out = corpus_pipeline.quality(spark, df, "")
    assert out.columns == df.columns
    assert rows_of(out) == Counter({k: n for k, n in rows_of(df).items() if brute_quality(k[1])[-1]})


@pytest.mark.parametrize("wrap", [lambda df: df, clashing])
def test_one_of_each_group_stays(spark, wrap):
    df = wrap(docs(spark))
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    rows = list(rows_of(df).elements())
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups, want = defaultdict(list), Counter()
    for i, r in enumerate(rows):
        if sets[i]:
            groups[find(i)].append(r)
        else:
            want[r] += 1  # without words: in no group
    kept = rows_of(out)
    assert Counter({r: n for r, n in kept.items() if not shingles(r[1])}) == want
    for members in groups.values():
        stays = [r for r in set(members) for _ in range(kept[r])]
        least = min((m[0] for m in members if m[0] is not None), default=None)
        assert len(stays) == 1 and stays[0][0] == least


def targets(sizes, share=1.5, times=2):
    """Targets by hand: the budget goes to the sources by weight, again and again, until none is above its most."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, budget = {}, share * sum(sizes.values())
    while True:
        left = [s for s in names if s not in full]
        level = (budget - sum(full.values())) / sum(weight[s] for s in left) if left else 0
        over = [s for s in left if level * weight[s] > times * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in left}
        full |= {s: times * sizes[s] for s in over}


@pytest.mark.parametrize("wrap", [lambda df: df, clashing])
def test_mixing_meets_its_targets(spark, wrap):
    df = wrap(docs(spark))
    out = corpus_pipeline.mixing(spark, df, "")
    assert out.columns == df.columns
    before, after = rows_of(df), rows_of(out)
    assert all(after[r] <= 2 * before[r] for r in after)
    sizes, taken, one = Counter(), Counter(), defaultdict(Counter)
    for r, n in before.items():
        sizes[r[3]] += n * size(r[1])
        taken[r[3]] += after[r] * size(r[1])
        one[r[3]][r[0]] += n * size(r[1])
    for source, goal in targets(sizes).items():
        assert abs(taken[source] - goal) <= max(one[source].values()) / 2 + 1e-6
    again = rows_of(corpus_pipeline.mixing(spark, wrap(docs(spark)).repartition(3), ""))
    assert again == after


@pytest.mark.parametrize("wrap", [lambda df: df, clashing])
def test_packing_places_every_token_once(spark, wrap):
    from tokenizers import Tokenizer

    from quillon.llm.queries import vocabulary

    out = corpus_pipeline.packing(spark, wrap(docs(spark)), "").collect()
    library = Tokenizer.from_file(vocabulary())
    lengths = Counter()
    for r, n in rows_of(docs(spark)).items():
        lengths[r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1] += n
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.doc_tokens].update(range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: set(v.values()) | {len(v)} for k, v in pieces.items()} == {k: {n, k[1]} for k, n in lengths.items()}
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_of_an_empty_table(spark):
    now = clashing(empty(spark))
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        if name != "packing":
            now = materialize(now, "empty-stage")
        assert now.count() == 0


def test_stages_one_after_the_other(spark, tmp_path):
    """run() is the stages on each other's rows, on a table with all the cases."""
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    now = docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, ""), "stage")
    want = Counter()
    for r, n in rows_of(now).items():
        want[r[0]] += n
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.start == 0)
    assert got == want
