"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import doc_rows, ship, slices


class PerfectHash:
    """Minimal perfect hash of byte strings to places 0..n-1 by displaced buckets; looking up verifies the key.

    Keys fall into n/2 buckets; largest buckets first, each tries seeds until
    all its keys land on free places. A key found elsewhere than its own place
    is not in the set.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = max(1, len(keys)), max(1, len(keys) // 2)
        self.seeds, self.keys = [0] * self.buckets, [b""] * self.n
        self.values = np.full(self.n, -1, np.int64)
        groups: dict[int, list[int]] = {}
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        taken: set[int] = set()
        spare = (i for i in range(self.n) if i not in taken)  # lone keys come last
        for b, own in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(own) == 1:  # a lone key takes the next free place, which is stored instead of a seed
                p = next(spare)
                self.seeds[b] = -1 - p
                self.keys[p], self.values[p] = keys[own[0]], own[0]
                continue
            seed, place, own_hashes = 0, self.place, [hashes[i] for i in own]
            while True:
                places = {place(h, seed) for h in own_hashes}
                if len(places) == len(own) and not places & taken:
                    break
                seed += 1
            taken |= places
            self.seeds[b] = seed
            for i in own:
                p = place(hashes[i], seed)
                self.keys[p], self.values[p] = keys[i], i

    def place(self, h: int, seed: int) -> int:
        if seed < 0:
            return -1 - seed
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def get(self, key: bytes) -> int:
        """The key's number in the list given at the start, or -1."""
        h = xxhash.xxh64_intdigest(key)
        p = self.place(h, self.seeds[h % self.buckets])
        return int(self.values[p]) if self.keys[p] == key else -1


class BytePairCoder:
    """Encodes pre-tokens by merge ranks (token bytes -> id, lower ids merge first) and decodes ids."""

    #: Pre-tokens of which the result is remembered, at most, before the memory is emptied.
    MEMO = 500_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.units, self.odd = re.compile(r"\s*\S+|\s+").findall, re.compile("[\x1c-\x1f]").search
        self.parts: dict[str, bytes] = {}
        self.tokens = sorted(ranks, key=ranks.get)
        self.ids = [ranks[t] for t in self.tokens]
        self.whole = PerfectHash(self.tokens)
        self.memo: dict[str, bytes] = {}
        self.decoded = dict(zip(self.ids, self.tokens, strict=True))
        dense = max(self.ids, default=-1) + 1
        sizes = np.zeros(dense, np.int64)
        sizes[self.ids] = [len(t) for t in self.tokens]
        self.flat, self.sizes = np.frombuffer(b"".join(self.tokens), np.uint8), sizes
        self.starts = np.zeros(dense, np.int64)
        self.starts[self.ids] = np.cumsum([0, *(len(t) for t in self.tokens)])[:-1]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: the lowest-ranked adjacent pair merges first, leftmost of equals."""
        n, rank = len(piece), self.ranks.get
        stop, before = list(range(1, n + 1)), list(range(-1, n))  # linked parts: part i is piece[i:stop[i]]
        bits = n.bit_length()
        low = (1 << bits) - 1
        # A heap entry packs the pair's rank, where its left part starts and where its right part stops.
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            e = heappop(heap)
            end, i = e & low, (e >> bits) & low
            j = stop[i]
            if not j or j >= n or stop[j] != end:
                continue  # one of the two parts has merged since
            stop[j], stop[i] = 0, end
            if end < n:
                before[end] = i
                k = stop[end]
                if (r := rank(piece[i:k])) is not None:
                    heappush(heap, (r << bits | i) << bits | k)
            if i:
                p = before[i]
                if (r := rank(piece[p:end])) is not None:
                    heappush(heap, (r << bits | p) << bits | end)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = stop[i]
        return out

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        k = self.whole.get(raw)
        return [self.ids[k]] if k >= 0 else self.merge(raw)

    def encode_unit(self, unit: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the pre-tokens of a part of a text."""
        parts, out = self.parts, []
        for piece in self.split(unit):
            ids = parts.get(piece)
            if ids is None:
                ids = array("I", self.encode_piece(piece)).tobytes()
                if len(piece) <= 64:
                    if len(parts) >= self.MEMO:
                        parts.clear()
                    parts[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> Iterator[bytes]:
        """encode_unit of consecutive parts of text.

        No pre-token holds white space after something else, and none looks
        back, so a text may be cut before every run of white space. (Of the
        separators U+001C to U+001F, expressions disagree whether they are
        white space; a text with one is not cut.)
        """
        memo = self.memo
        for unit in [text] if self.odd(text) else self.units(text):
            ids = memo.get(unit)
            if ids is None:
                ids = self.encode_unit(unit)
                if len(unit) <= 64:
                    if len(memo) >= self.MEMO:
                        memo.clear()
                    memo[unit] = ids
            yield ids

    def encode_ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode(text)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered from one flat table."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = self.starts[ids] - (ends - sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(shift, sizes) + np.arange(total)].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: base64 token, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> BytePairCoder:
    """One coder per Python worker; path is a vocabulary file that every executor has."""
    return BytePairCoder(read_ranks(path), pattern)


TOKENS_DDL = "doc_id long, ids array<int>"


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, ids (array<int>). Null texts are empty and have no ids; rows without doc_id are left out."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in (s for b in batches for s in slices(b)):
            ids = [c.encode_ids(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    return doc_rows(docs).mapInArrow(run, TOKENS_DDL)


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, content (binary) of the ids that encode_documents gave."""
    ship(tokens.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in (s for b in batches for s in slices(b)):
            ids = batch.column(1)
            content = [c.decode(ids[i].values.to_numpy(zero_copy_only=False)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], schema=schema)

    return tokens.mapInArrow(run, "doc_id long, content binary")


DIGESTS_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) -> encoded, decoded again from the ids alone, as digests; ids never leave the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c = coder(path, pattern)
        names = np.array([str(i) for i in range(len(c.sizes))], dtype=object)
        for batch in (s for b in batches for s in slices(b)):
            out = []
            for text in batch.column(1).to_pylist():
                ids = c.encode_ids(text)
                digest, decoded = hashlib.sha256(), hashlib.sha256()
                for a in range(0, len(ids), 1 << 16):
                    part = ids[a : a + (1 << 16)]
                    digest.update(((" " if a else "") + " ".join(names[part])).encode())
                    decoded.update(c.decode(part))
                out.append((len(ids), digest.hexdigest(), decoded.hexdigest()))
            n, d, e = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d), pa.array(e)], schema=schema)

    return run


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, SHA-256 of the ids and of the decoded bytes, without writing the ids anywhere.

    Null texts are empty and have no tokens; repeated rows are returned each;
    rows without doc_id are left out; other columns are ignored; an empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    return doc_rows(docs).mapInArrow(round_trip(path, pattern), DIGESTS_DDL)
