"""Byte-level BPE with a public vocabulary, encoded by a bitmap rank queue."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies of public tokenizers lie; a parameter of every operator here.
VOCABULARIES = os.environ.get("LODESTACK_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how texts are cut into pre-tokens before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers; when so many are known it starts anew.
REMEMBERED = 1_000_000


class RankQueue:
    """Priority queue over merge ranks with constant-time operations.

    One bucket per rank holds the positions pushed with it. Three levels of 64-bit
    words mark the ranks whose bucket is not empty; the next rank is found by
    find-first-set from the top level down.
    """

    def __init__(self, size: int):
        n0 = (size + 63) // 64
        n1 = (n0 + 63) // 64
        self.low, self.mid, self.top = [0] * n0, [0] * n1, 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop_bucket(self) -> tuple[int, list[int]] | None:
        """The lowest rank with all its positions; the queue forgets both."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = (b << 6) | ((m & -m).bit_length() - 1)
        w = self.low[a]
        rank = (a << 6) | ((w & -w).bit_length() - 1)
        self.low[a] = w = w & (w - 1)
        if not w:
            self.mid[b] = m = m & (m - 1)
            if not m:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """Encodes texts with a ``.tiktoken`` rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.by_id = {v: k for k, v in self.ranks.items()}
        self.bytes_id = [self.ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN)

    def rank(self, a: int, b: int) -> int:
        """The id of two neighbouring tokens merged, or -1; equal to their merge rank."""
        r = self.pairs.get((a, b))
        if r is None:
            r = self.pairs[a, b] = self.ranks.get(self.by_id[a] + self.by_id[b], -1)
        return r

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        Tokens are a linked list over byte positions. The queue gives the lowest rank
        with its positions, which are worked off from left to right; an entry is stale
        if its position was merged away or its pair has another rank by now.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.bytes_id[x] for x in piece]
        n, rank, queue = len(ids), self.rank, self.queue
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if (r := rank(ids[i], ids[i + 1])) >= 0:
                queue.push(r, i)
        while (got := queue.pop_bucket()) is not None:
            r, places = got
            places.sort()
            for at, i in enumerate(places):
                j = after[i]
                if ids[i] < 0 or j >= n or rank(ids[i], ids[j]) != r:
                    continue
                ids[i], ids[j] = r, -1
                k, h, least = after[j], before[i], r
                after[i] = k
                if k < n:
                    before[k] = i
                    if (x := rank(r, ids[k])) >= 0:
                        queue.push(x, i)
                        least = min(least, x)
                if h >= 0 and (x := rank(ids[h], r)) >= 0:
                    queue.push(x, h)
                    least = min(least, x)
                if least < r:  # the merge opened a better one: it goes before the rest of this bucket
                    for later in places[at + 1 :]:
                        queue.push(r, later)
                    break
        return [x for x in ids if x >= 0]

    def word(self, text: str) -> bytes:
        """The ids, as packed 32-bit integers, of a piece of text that neighbours no other pre-token."""
        out: list[int] = []
        for m in self.split.findall(text):
            out += self.merge(m.encode("utf-8", "surrogatepass"))
        return np.array(out, np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit integers.

        A single space between two characters that are no white space begins a pre-token
        wherever it stands, so a text falls apart there into words that can be encoded, and
        remembered, on their own. Words with other white space in them are as good as any.
        """
        parts = text.split(" ")
        known = self.words
        if len(parts) == 1:
            pieces = parts
        else:
            pieces = [parts[0]]
            add = pieces.append
            open_ = not parts[0] or parts[0][-1].isspace()
            for p in parts[1:]:
                if open_ or not p or p[0].isspace():
                    pieces[-1] += " " + p  # the space has white space beside it
                else:
                    add(" " + p)
                open_ = not p or p[-1].isspace()
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            out = []
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    ids = self.word(p)
                    if len(p) <= 64:
                        known[p] = ids
                out.append(ids)
            return b"".join(out)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)


#: Rows whose ids are handed over at once.
ROWS_AT_ONCE = 512


def _texts(col: pa.Array) -> list[str]:
    return ["" if t is None else t for t in col.to_pylist()]


def encode_column(df: DataFrame, key: str, text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key, ids``: the ids of every text, without special tokens.

    Names of special tokens in a text are ordinary text. Defined cases: an empty and a
    null text have no ids, that is an empty list; the longest text is encoded whole.
    A projection: no shuffle, no limit, and a worker holds one batch of ``ROWS_AT_ONCE``
    texts with their ids besides the words it remembers.
    """
    path = f"{folder}/{vocabulary}.tiktoken"
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                packed = [e.encode(t) if t else b"" for t in _texts(b.column(1))]
                ends = np.zeros(len(packed) + 1, np.int64)
                np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """The columns ``keep`` with ``n_tokens``, the number of ids of each text; 0 for empty and null texts."""
    path = f"{folder}/{vocabulary}.tiktoken"
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = [len(e.encode(t)) // 4 if t else 0 for t in _texts(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, f"{schema}, n_tokens bigint")
