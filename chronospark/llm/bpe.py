"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap for the rest.

The vocabulary is read on the driver, hashed there once and broadcast; its size does
not depend on the data.  Each text is split by the pattern; a pre-token that is in the
vocabulary is resolved by the hash with one comparison of bytes, any other one by
merging linked bytes in order of rank from a heap.

Nulls and empty texts have no tokens.  Rows keep their own identity, so repeated rows
give repeated results.  No row depends on another one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import giving_back, small_batches
from ._text import U, column_bytes, mix, span_hashes


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank in each line) in order of rank."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash by displacement: n keys fill exactly n slots."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // 3)
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        home = (keys % U(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        for b in np.argsort(-sizes, kind="stable"):
            own = keys[order[edges[b] : edges[b + 1]]]
            if len(own) == 0:
                break
            if len(own) == 1:
                continue
            tries = np.arange(1, 65, dtype=U)
            while True:
                slots = (mix(own[None, :] + tries[:, None] * U(0x9E3779B97F4A7C15)) % U(n)).astype(np.int64)
                ordered = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (np.diff(ordered, axis=1) != 0).all(axis=1)
                if good.any():
                    k = int(np.flatnonzero(good)[0])
                    self.shift[b] = int(tries[k])
                    taken[slots[k]] = True
                    break
                tries = tries + U(64)
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(sizes == 1):  # a lone key goes straight to a free slot
            self.shift[b] = -1 - int(next(free))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % U(self.buckets)).astype(np.int64)]
        moved = mix(keys + np.maximum(shift, 0).astype(U) * U(0x9E3779B97F4A7C15)) % U(self.size)
        return np.where(shift < 0, -1 - shift, moved.astype(np.int64))


def _keys(values: Iterable[bytes]) -> np.ndarray:
    buf, off = column_bytes(pa.array(values, pa.binary()).cast(pa.large_binary()).view(pa.large_string()))
    return span_hashes(buf, off[:-1], off[1:])


class Vocabulary:
    """Ranks with their two lookup tiers; small enough to broadcast."""

    #: Encoded pre-tokens in each of the two memories of a worker.
    REMEMBERED = 150_000

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(keys := _keys(tokens))
        self.at = np.full(len(tokens), -1, np.int64)
        self.at[self.hash(keys)] = np.arange(len(tokens))

    def ready(self) -> Vocabulary:
        """Add what only a worker needs and is cheaper to build than to send."""
        if not hasattr(self, "memory"):
            import regex

            self.split = regex.compile(self.pattern).findall
            self.ranks = {t: i for i, t in enumerate(self.tokens)}
            self.memory: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
            self.before: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        return self

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("tokens", "pattern", "hash", "at")}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge linked bytes, lowest rank first and leftmost among equals."""
        ranks, n = self.ranks, len(piece)
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = after[i]
            if middle < 0 or middle >= n or after[middle] != end:
                continue  # one of its halves has been merged meanwhile
            after[middle] = -1
            after[i] = end
            if end < n:
                before[end] = i
                if (far := after[end]) > 0 and (r := ranks.get(piece[i:far])) is not None:
                    heappush(heap, (r, i, far))
            if (left := before[i]) >= 0 and (r := ranks.get(piece[left:end])) is not None:
                heappush(heap, (r, left, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def learn(self, pieces: list[str]) -> None:
        """Resolve pre-tokens that are not remembered."""
        raw = [p.encode() for p in pieces]
        found = self.at[self.hash(_keys(raw))].tolist()
        tokens, merge, decode, memory = self.tokens, self.merge, self.decode, self.memory
        for piece, data, rank in zip(pieces, raw, found):
            ids = (rank,) if tokens[rank] == data else merge(data)
            memory[piece] = (ids, ",".join(map(str, ids)), decode(ids))

    def split_all(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of each text, all of them known to the memory afterwards.

        What is new in all texts is resolved at once.  A full memory becomes the old one,
        from which what is still in use comes back, so common pre-tokens stay known.
        """
        self.ready()
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.memory) > self.REMEMBERED:
            self.before, self.memory = self.memory, {}
        memory, before = self.memory, self.before
        new = set().union(*pieces).difference(memory)
        if before:
            for p in new & before.keys():
                memory[p] = before[p]
            new = new.difference(memory)
        if new:
            self.learn(list(new))
        return pieces

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, as encode_ordinary of the public library gives them."""
        known = self.split_all(texts)
        for pieces in known:
            yield [i for p in map(self.memory.__getitem__, pieces) for i in p[0]]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: how many ids, SHA-256 of them (decimal, comma-joined) and of the bytes that they decode to.

        What the ids of a pre-token are written and decoded as is remembered with it.
        """
        known = self.split_all(texts)
        for pieces in known:
            ids, said, raw = zip(*map(self.memory.__getitem__, pieces)) if pieces else ((), (), ())
            yield sum(map(len, ids)), hashlib.sha256(",".join(said).encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _shared(df: DataFrame, path: str, pattern: str):
    return df.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode whole texts: id, n_tokens and ids (array of int).

    With ``digests`` the ids are decoded again in the same task, and SHA-256 of the
    comma-joined ids and of the decoded bytes are returned instead of the ids, so that
    the token lists need not leave the worker.
    """
    shared = _shared(small_batches(df), path, pattern)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.ready()
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                if digests:
                    count, one, two = (list(x) for x in zip(*words.digests(texts))) if texts else ([], [], [])
                else:
                    one = list(words.encode(texts))
                    count = [len(ids) for ids in one]
                columns = [batch.column(0), pa.array(count, pa.int64())]
                columns += [pa.array(one, pa.string()), pa.array(two, pa.string())] if digests else [pa.array(one, pa.list_(pa.int32()))]
                names = [id_col, "n_tokens"] + (["ids_sha256", "decoded_sha256"] if digests else ["ids"])
                yield pa.RecordBatch.from_arrays(columns, names)

    out = f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(giving_back(run), out)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode arrays of ids: id and ``decoded`` (binary).  A null array gives no bytes."""
    shared = _shared(df, path, pattern)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.ready()
        for batch in batches:
            raw = [words.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "decoded"])

    return df.select(F.col(id_col), F.col(ids_col).alias("__ids")).mapInArrow(giving_back(run), f"`{id_col}` {kind}, decoded binary")
