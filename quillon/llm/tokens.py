"""Token ids and token counts of public tokenizers, computed once per white-space chunk and remembered.

Both vocabularies used here drop white space before merging and never merge across it, so the tokens
of a text are those of its chunks, one after the other; the tests hold this against the library.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np

from quillon.llm.textwork import utf8

#: Bytes that a worker's memory of chunks may take before it starts afresh, and what an entry costs beside its own
#: bytes; longer chunks are not remembered. Bounds memory, not results.
REMEMBERED, ENTRY, LONGEST = 192 << 20, 200, 100


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def specification(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=2)
def word_ends(path: str) -> np.ndarray:
    """Whether an id closes a word, by id."""
    model = specification(path)["model"]
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
    return ends


class ChunkIds:
    """Ids of texts as little-endian unsigned integers of `width` bytes, by the tokenizers library.

    The library gets the new chunks of a batch of texts. Plain words (letters of Latin scripts, below U+0250, and at
    most one sign of punctuation after them, which is a word of its own) go joined with blanks, JOINED at a time, and
    are cut apart at the ids that close a word; their number has to be right, else the chunks go as single texts, as
    all other chunks do.
    """

    JOINED = 2000

    def __init__(self, path: str, width: int = 4):
        self.tok, self.ends, self.width, self.dtype = library(path), word_ends(path), width, np.dtype(f"<u{width}")
        self.known: dict[bytes, bytes] = {}
        self.size = 0
        self.plain = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{1,100}([.,;:!?)]?)\\Z").match

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        texts = b"\n".join(new).decode("utf-8", "surrogatepass").split("\n")
        plain = list(map(self.plain, texts))
        words, closing, others, out = [], [], [], {}
        for i, m in enumerate(plain):
            if m:
                words.append(i)
                closing.append(2 if m[1] else 1)
            else:
                others.append(i)
        for at in range(0, len(words), self.JOINED):
            some = words[at : at + self.JOINED]
            ids = np.array(self._encode([" ".join([texts[i] for i in some])])[0], self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            upto = np.cumsum(closing[at : at + self.JOINED])
            if len(stops) != upto[-1]:
                others += some
                continue
            raw, cuts = ids.tobytes(), [0, *(stops[upto - 1] * self.width).tolist()]
            out.update(zip([new[i] for i in some], [raw[a:z] for a, z in pairwise(cuts)]))
        for at in range(0, len(others), self.JOINED):
            some = others[at : at + self.JOINED]
            out.update((new[i], np.array(ids, self.dtype).tobytes()) for i, ids in zip(some, self._encode([texts[i] for i in some])))
        return out

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, in order; null is empty."""
        split = [utf8(t).split() for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            found = self._learn(list(new))
            self.known.update(found)
            self.size += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)
        get = self.known.__getitem__
        out = [b"".join(map(get, s)) for s in split]
        for chunk in new:
            if len(chunk) > LONGEST:
                self.size -= len(chunk) + len(self.known.pop(chunk)) + ENTRY
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        return out

    def text(self, text: str | None) -> bytes:
        return self.texts([text])[0]


@lru_cache(maxsize=2)
def chunk_ids(path: str, width: int = 4) -> ChunkIds:
    """The worker's ChunkIds; what it remembers serves its later tasks too."""
    return ChunkIds(path, width)


class MergeCounter(dict):
    """chunk (bytes) -> number of tokens, by heap-and-linked-list byte-pair merging; makes no ids.

    A piece starts as one symbol a character (the last one carries the word end). The heap holds the ranks and
    places of adjacent pairs, one integer each; the lowest is popped, merged into its left symbol, and its two new
    neighbour pairs are pushed. Entries whose place holds another pair by now are skipped. Tokens = symbols - merges.
    """

    def __init__(self, path: str):
        spec = specification(path)
        model = spec["model"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.end = model["end_of_word_suffix"] or ""
        special = [t["content"] for t in spec["added_tokens"] if not t["normalized"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.tok = library(path)
        self.plain = re.compile(rb"[A-Za-z]+\Z")
        self.size = 0

    def __missing__(self, chunk: bytes) -> int:
        if self.plain.match(chunk):
            value = self.piece(chunk.lower().decode())
        else:
            value = self.chunk(chunk.decode("utf-8", "surrogatepass"))
        if len(chunk) <= LONGEST:
            self.size += len(chunk) + ENTRY
            if self.size > REMEMBERED:
                self.clear()
                self.size = len(chunk) + ENTRY
            self[chunk] = value
        return value

    def chunk(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            if part:
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                    total += self.piece(piece)
        return total

    def piece(self, piece: str) -> int:
        symbols: list[str | None] = list(piece)
        if not symbols:
            return 0
        symbols[-1] += self.end
        n, rank, merged = len(symbols), self.rank.get, 0
        make = list if n < 1000 else lambda r: array("q", r)
        after, before = make(range(1, n + 1)), make(range(-1, n - 1))
        bits = n.bit_length()
        place = (1 << bits) - 1
        heap = [r << bits | i for i, pair in enumerate(pairwise(symbols)) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            lowest = heapq.heappop(heap)
            i = lowest & place
            if (j := after[i]) >= n or rank((symbols[i], symbols[j])) != lowest >> bits:
                continue
            symbols[i], symbols[j] = joint, _ = symbols[i] + symbols[j], None
            merged += 1
            after[i] = k = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if (r := rank((joint, symbols[k]))) is not None:
                    heapq.heappush(heap, r << bits | i)
            if (h := before[i]) >= 0 and (r := rank((symbols[h], joint))) is not None:
                heapq.heappush(heap, r << bits | h)
        return n - merged

    def text(self, text: str | None) -> int:
        return sum(map(self.__getitem__, utf8(text).split()))


@lru_cache(maxsize=2)
def merge_counter(path: str) -> MergeCounter:
    """The worker's MergeCounter; what it remembers serves its later tasks too."""
    return MergeCounter(path)


def forget() -> None:
    """Drop what this worker's tokenizers remember, and the tokenizers."""
    for kept in (chunk_ids, merge_counter, library, specification, word_ends):
        kept.cache_clear()
