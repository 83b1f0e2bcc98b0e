import json
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm.packing import pack_documents, pack_window
from quillon.llm.token_counts import count_tokens
from quillon.llm import token_files
from quillon.llm.token_files import SequenceReader, read_token_files, write_token_files
from quillon.llm.tokens import ChunkIds, MergeCounter
from tests.llm.cases import awkward, clashing, empty

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
COUNTER, IDS = MergeCounter(VOCABULARY), ChunkIds(VOCABULARY)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


texts = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("abcAB'st \t\n\x0b\x1c 　́İΣς<|>endoftext"))), max_size=60)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_counts_and_ids_are_the_librarys(text):
    assert COUNTER.text(text) == len(ids_of(text))
    assert np.frombuffer(IDS.text(text), "<u4").tolist() == ids_of(text)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|startoftext|><|endoftext|>", "x" * 5000, "it's we'll I'D", "日本語テキスト 123 4.5!?", "ﬁ ½ Ⅷ"])
def test_special_cases(text):
    assert COUNTER.text(text) == len(ids_of(text))


def test_count_operator(spark):
    docs = clashing(awkward(spark))
    got = sorted(count_tokens(docs, VOCABULARY).collect(), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids_of(r.text)), len(ids_of(r.text)) > 2048) for r in docs.collect()), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert count_tokens(empty(spark), VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([16, 64, 100]))
def test_packing_places_every_token_once(lengths, length):
    pieces, n = pack_window(lengths, length)
    cover = [np.zeros(x, int) for x in lengths]
    fill = {}
    for doc, start, size, seq, offset in pieces:
        assert size > 0
        cover[doc][start : start + size] += 1
        fill.setdefault(seq, []).append((offset, size))
    assert all((c == 1).all() for c in cover)
    assert set(fill) == set(range(n))
    for spans in fill.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at == length or at & (at - 1) == 0, "only power-of-two sequences are shorter"


def test_packing_balances_costs():
    rng = np.random.default_rng(5)
    pieces, n = pack_window(rng.integers(20, 900, 800).tolist(), 4096)
    cost = np.zeros(n)
    size = np.zeros(n)
    for _, _, m, s, _ in pieces:
        cost[s] += m + m * m / 2048
        size[s] += m
    full = cost[size == 4096]
    assert full.std() / full.mean() < 0.05


def test_packing_operator(spark):
    docs = clashing(awkward(spark))
    rows = pack_documents(docs, VOCABULARY, 2, with_ids=True).collect()
    by = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by.setdefault(r.doc_id, []).append(r)
    for r in docs.filter("doc_id is not null and doc_id <> 7").collect():
        parts = sorted(by[r.doc_id], key=lambda p: p.start)
        assert sum((p.ids for p in parts), []) == ids_of(r.text) + [2]
        assert {p.doc_tokens for p in parts} == {len(ids_of(r.text)) + 1}
    assert sum(r.length for r in rows) == sum(len(ids_of(r.text)) + 1 for r in docs.collect())
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
    assert pack_documents(empty(spark), VOCABULARY, 2).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    docs = clashing(awkward(spark))
    manifest = write_token_files(docs, VOCABULARY, 1, f"file://{tmp_path}/tokens", length=64, rows=4, files=3)
    got = read_token_files(manifest).collect()
    rows = docs.collect()
    want = [ids_of(r.text) + [1] for r in sorted(rows, key=lambda r: -1 if r.doc_id is None else r.doc_id)]
    assert sorted(r.n_tokens for r in got) == sorted(map(len, want))
    got.sort(key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    before = 0
    for r in got:
        assert r.start == before
        before += r.n_tokens
    crc = {}
    for r in rows:
        crc.setdefault(r.doc_id, set()).add(zlib.crc32(np.array(ids_of(r.text) + [1], "<u4").tobytes()))
    assert all(r.ids_crc32 in crc[r.doc_id] for r in got)
    files = [f for f in os.listdir(tmp_path / "tokens") if f.endswith(".arrow") and ".index" not in f]
    assert len(json.loads((tmp_path / "tokens" / "manifest.json").read_text())) == len(files)
    reader = SequenceReader(f"file://{tmp_path}/tokens/{sorted(files)[-1]}")
    ids, mask = reader.sequence(len(reader) - 1)
    assert len(ids) == len(mask) == 64 and mask[0] and not ids[~mask].any()
    held_ids, held_mask = reader.batches[0].columns
    buffers = [x.flatten().buffers()[1] for x in (held_ids, held_mask.dictionary)]
    for i in range(len(reader)):
        assert reader.sequence(i)[1].all() == (i < len(reader) - 1 or mask.all())
    for view, held in zip(reader.sequence(0), buffers):  # views of the memory-mapped file
        assert held.address <= view.__array_interface__["data"][0] < held.address + held.size and not view.flags.owndata
    other = write_token_files(docs, VOCABULARY, 1, f"file://{tmp_path}/tokens", length=64, rows=4, files=3)  # as a repeated task would
    assert not {r.path for r in other.collect()} & {r.path for r in manifest.collect()}
    assert sorted(map(str, read_token_files(manifest).collect())) == sorted(map(str, got))


def test_number_of_token_files_follows_the_input(spark, tmp_path, monkeypatch):
    docs = awkward(spark)
    docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    size = sum(os.path.getsize(f"{tmp_path}/docs/{f}") for f in os.listdir(f"{tmp_path}/docs") if f.endswith(".parquet"))
    assert token_files.input_bytes(stored, "text") == size
    assert token_files.input_bytes(docs, "text") == sum(len((r.text or "").encode()) for r in docs.collect())
    assert token_files.input_bytes(empty(spark), "text") == 0
    monkeypatch.setattr(token_files, "FILE_BYTES", size // 10)
    manifest = write_token_files(stored, VOCABULARY, 1, f"file://{tmp_path}/many")
    assert 5 <= manifest.count() <= 11 and sum(r.n_docs for r in manifest.collect()) == docs.count()


def test_token_files_empty(spark, tmp_path):
    manifest = write_token_files(empty(spark), VOCABULARY, 1, f"file://{tmp_path}/none")
    assert manifest.count() == 0 and read_token_files(manifest).count() == 0
