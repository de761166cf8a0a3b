"""Repeated 50-byte strings by a distributed difference-cover suffix sort.

1. Winnowed fingerprints (one of 24 bytes in every 50) find which stretches can
   repeat at all: a string that occurs twice has its fingerprint twice.
2. The contexts of repeated fingerprints are dealt out by fingerprint, so that all
   occurrences of a string meet in one place. Equal contexts are one there, and
   a fingerprint with one context alone needs no more than its smallest document.
3. The others' suffixes are sorted by a difference cover modulo 3: triples at
   places 1 and 2 are sorted and named, names recurse (to a depth that covers
   50 bytes), the remaining suffixes are merged in, and neighbours with equal
   50-byte prefixes form classes. Every start in a class goes whose document is
   not the smallest of the class.
4. Runs of such starts are gathered by document and cover bytes there.

Texts equal to one of a smaller doc_id need none of this: they go whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, cut, doc_rows, forget, mix64, ship, slices

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
BASE = U64(0xD1342543DE82EF95)
#: Bytes of text whose fingerprints are combined before they are sent.
GROUP_BYTES = 16 << 20
#: Bytes of contexts that are sorted at once, at most about; sixteen times as many fingerprints, and eight times as many contexts, meet in one place.
BUCKET_BYTES = 2 << 20
#: A fingerprint in this many groups deals its strings out one by one instead of by its own value.
HOT_GROUPS = 64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at every place."""
    n = len(data) - GRAM + 1
    own, step, power, eight = data.astype(np.uint64) + U64(1), 1, np.array([BASE]), None
    while step < 16:  # by doubling: 1, 2, 4, 8, 16 bytes
        own = own[: len(own) - step] * power + own[step:]
        power, step = power * power, step * 2
        eight = own if step == 8 else eight
    return mix64(own[:n] * U64(0x9E3779B97F4A7C15) + mix64(eight[16 : 16 + n]))


def fingerprints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per start of a LENGTH-byte string its smallest gram hash; and the gram hashes. data has LENGTH bytes at least."""
    h = gram_hashes(data)
    best, width = h, 1
    while width < WINDOW:  # minima of windows by doubling, then two overlapping windows
        step = min(width, WINDOW - width)
        best = np.minimum(best[step:], best[: len(best) - step])
        width += step
    return best, h


def text_name(digest: bytes) -> int:
    """The first 64 bits of a text's SHA-256."""
    return int.from_bytes(digest[:8], "big", signed=True)


FLAGS_DDL = "bucket int, fps binary, owners binary, docs binary"


def _blob(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def doc_blob(x: np.ndarray) -> bytes:
    """Identifiers in four bytes each if they fit, else in eight."""
    return _blob(x, "<u4" if x.min() >= 0 and x.max() < 1 << 32 else "<i8")


def doc_array(blob: bytes, n: int) -> np.ndarray:
    """The n identifiers of a doc_blob."""
    return np.frombuffer(blob, "<u4" if len(blob) == 4 * n else "<i8").astype(np.int64)


def send_fingerprints(n_buckets: int, group_bytes: int):
    """text -> per group and bucket: fingerprints of one text each, and which; bucket -1: (text, fingerprints) that several texts of the group have.

    A text is named by 64 bits of its digest, so exact copies are one.
    """
    schema = pa.schema([("bucket", pa.int32()), ("fps", pa.binary()), ("owners", pa.binary()), ("docs", pa.binary())])

    def flush(fps, docs):
        fp, doc = np.concatenate(fps), np.concatenate(docs)
        order = np.lexsort((doc, fp))
        fp, doc = fp[order], doc[order]
        first = np.append(True, fp[1:] != fp[:-1])
        starts = np.flatnonzero(first)
        here = np.maximum.reduceat(doc, starts) != doc[first]
        inside = np.repeat(here, np.diff(np.append(starts, len(fp))))
        own, f = doc[inside], fp[inside]
        by_doc = np.argsort(own, kind="stable")
        own, f = own[by_doc], f[by_doc]
        names, starts = np.unique(own, return_index=True)
        rows = [(-1, _blob(part, "<u8"), b"", _blob(np.array([d]), "<i8")) for d, part in zip(names, np.split(f, starts[1:]), strict=True)] if len(names) else []
        fp, doc = fp[first], doc[first]
        bucket = (fp >> U64(32)) % U64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1).astype(np.uint64))
        for b in range(n_buckets):
            own = order[edges[b] : edges[b + 1]]
            if len(own):
                ids, owner = np.unique(doc[own], return_inverse=True)
                rows.append((b, _blob(fp[own], "<u8"), _blob(owner, "<u2" if len(ids) <= 1 << 16 else "<u4"), _blob(ids, "<i8")))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        fps, docs, size = [], [], 0
        for batch in (s for b in batches for s in slices(b)):
            for text in batch.column(0).cast(pa.binary()):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                d = text_name(hashlib.sha256(data).digest())
                f = fingerprints(data)[0]
                own = np.unique(f[np.append(True, f[1:] != f[:-1])])
                fps.append(own)
                docs.append(np.full(len(own), d))
                size += len(data)
                if size >= group_bytes:
                    yield flush(fps, docs)
                    fps, docs, size = [], [], 0
        if fps:
            yield flush(fps, docs)

    return run


REPEATED_DDL = "name long, fps binary, hot binary, sent boolean"
REPEATED = pa.schema([("name", pa.int64()), ("fps", pa.binary()), ("hot", pa.binary()), ("sent", pa.bool_())])


def find_repeated(hot_groups: int):
    """A partition of buckets -> per text and bucket the fingerprints that another text has too, and whether each is hot.

    Texts that their group did not send have no flags yet (sent is false). Rows
    without name hold the hot fingerprints, each once, to flag those texts by.
    """

    def finish(rows):
        fp = np.concatenate([np.frombuffer(r[0], "<u8") for r in rows])
        doc = np.concatenate([np.frombuffer(r[2], "<i8")[np.frombuffer(r[1], "<u4" if 2 * len(r[1]) == len(r[0]) else "<u2")] for r in rows])
        order = np.argsort(fp, kind="stable")
        fp, doc = fp[order], doc[order]
        starts = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
        counts = np.diff(np.append(starts, len(fp)))
        several = np.repeat(np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts), counts)
        hot = np.repeat(counts >= hot_groups, counts)
        # Hot for all or for none: a fingerprint of one sent text may have other texts that were not sent.
        every = np.unique(fp[hot])
        out = [(None, _blob(every, "<u8"), b"", True)] if len(every) else []
        fp, doc, hot = fp[several], doc[several], hot[several]
        order = np.argsort(doc, kind="stable")
        fp, doc, hot = fp[order], doc[order], hot[order]
        names, starts = np.unique(doc, return_index=True)
        ends = np.append(starts, len(doc))[1:]
        return out + [(int(d), _blob(fp[a:b], "<u8"), _blob(hot[a:b], "u1"), True) for d, a, b in zip(names, starts, ends, strict=True)]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), REPEATED, strict=True)], schema=REPEATED)

    def run(batches):
        last, rows = None, []
        for batch in (s for b in batches for s in slices(b, 64)):
            local = []
            for bucket, fps, owners, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket == -1:
                    local.append((int(np.frombuffer(docs, "<i8")[0]), fps, bytes(len(fps) // 8), False))
                    continue
                if bucket != last and rows:
                    if out := finish(rows):
                        yield batch_of(out)
                    rows = []
                last = bucket
                rows.append((fps, owners, docs))
            if local:
                yield batch_of(local)
        if rows and (out := finish(rows)):
            yield batch_of(out)

    return run


SINGLE_DDL = "name long, fps binary"
SINGLE = pa.schema([("name", pa.int64()), ("fps", pa.binary())])


def single_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, fps) -> one row per fingerprint."""
    for batch in (s for b in batches for s in slices(b, 64)):
        names, fps = [], []
        for name, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            names += [name] * (len(blob) // 8)
            fps += [blob[i : i + 8] for i in range(0, len(blob), 8)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(fps, pa.binary())], schema=SINGLE)


#: Bytes of the longest context: WINDOW starts.
WIDE = LENGTH + WINDOW - 1
WIDE += -WIDE % 8
CONTEXTS_DDL = "spot int, docs binary, starts binary, counts binary, keys binary, data binary"
CONTEXTS = pa.schema([("spot", pa.int32()), *((c, pa.binary()) for c in ("docs", "starts", "counts", "keys", "data"))])


def context_rows(buf: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The strings of buf (padded by WIDE bytes) at the given places as rows of WIDE bytes, zeros after their end."""
    rows = np.lib.stride_tricks.as_strided(buf, (len(buf) - WIDE + 1, WIDE), (1, 1))[at]
    rows[np.arange(WIDE) >= length[:, None]] = 0
    return rows


def by_content(rows: np.ndarray, count: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal contexts are neighbours, by document, and where each new one starts in it.

    If two different contexts have one 64-bit hash, equal ones may be told apart;
    the sort finds them all the same.
    """
    words = rows.view(np.uint64)
    h = key ^ (count.astype(np.uint64) << U64(56))
    for k in range(words.shape[1]):
        h = mix64(h * BASE + words[:, k])
    order = np.lexsort((doc, h))
    a, b = order[1:], order[:-1]
    new = (h[a] != h[b]) | (key[a] != key[b]) | (count[a] != count[b])
    again = np.flatnonzero(~new)
    new[again] = (words[a[again]] != words[b[again]]).any(1)
    return order, np.append(True, new)


def find_contexts(data: np.ndarray, known: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, counts and keys of the runs of starts whose strings share one of the known fingerprints; a run has WINDOW starts at most."""
    f, h = fingerprints(data)
    found = np.minimum(np.searchsorted(known, f), len(known) - 1)
    starts = np.flatnonzero(known[found] == f)
    f, is_hot = f[starts], hot[found[starts]]
    firsts = np.flatnonzero(np.append(True, (np.diff(starts) != 1) | (f[1:] != f[:-1]) | is_hot[1:])[: len(starts)])
    count, key, is_hot, start = np.diff(np.append(firsts, len(starts))), f[firsts], is_hot[firsts], starts[firsts]
    parts = -(-count // WINDOW)
    inside = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start, key = np.repeat(start, parts) + WINDOW * inside, np.repeat(key, parts)
    count, is_hot = np.minimum(np.repeat(count, parts) - WINDOW * inside, WINDOW), np.repeat(is_hot, parts)
    at = start[is_hot]  # strings with a hot fingerprint are dealt by all their bytes
    key[is_hot] = mix64(mix64(mix64(h[at]) + h[at + GRAM]) + h[at + LENGTH - GRAM])
    return start, count, key


def send_contexts(n_spots: int, group_bytes: int, shift: int):
    """(number, text, fps, hot) -> per group and spot the contexts: runs of starts of strings that share one fingerprint, and the bytes they cover.

    Numbers without their last shift bits are doc_ids. Within a group equal contexts are
    sent once for each text of the smallest doc_id; the others' starts are removed
    for certain and come as spot -1. A group may end inside a document.
    """

    def flush(texts, group):
        doc, at, start, count, key = (np.concatenate(c) for c in zip(*group, strict=True))
        buf = np.frombuffer(b"".join([*texts, bytes(WIDE)]), np.uint8)
        rows = context_rows(buf, at, count + LENGTH - 1)
        order, new = by_content(rows, count, key, doc)
        doc, start, count, key, rows = doc[order], start[order], count[order], key[order], rows[order]
        sent = doc >> shift == (doc[new] >> shift)[np.cumsum(new) - 1]
        out = []
        if not sent.all():
            out.append((-1, doc_blob(doc[~sent]), _blob(start[~sent], "<i4"), _blob(count[~sent], "u1"), b"", b""))
        doc, start, count, key, rows = doc[sent], start[sent], count[sent], key[sent], rows[sent]
        spot = ((key >> U64(32)) % U64(n_spots)).astype(np.int64)
        order = np.argsort(spot, kind="stable")
        own = spot[order]
        edges = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for k in np.split(order, edges[1:]):
            data = rows[k][np.arange(WIDE) < (count[k] + LENGTH - 1)[:, None]]
            # Half of the key is enough within a spot: keys that agree in it are sorted as one.
            out.append((int(spot[k[0]]), doc_blob(doc[k]), _blob(start[k], "<i4"), _blob(count[k], "u1"), _blob(key[k] & U64(0xFFFFFFFF), "<u4"), data.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CONTEXTS, strict=True)], schema=CONTEXTS)

    def run(batches):
        texts, group, size, bytes_of, base, step = [], [], 0, 0, 0, max(group_bytes // 150, 1)
        for batch in (s for b in batches for s in slices(b, 64)):
            for d, text, fps, hot in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                known, index = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in fps]), return_inverse=True)
                is_hot = np.bincount(index, np.concatenate([np.frombuffer(x, "u1") for x in hot])) > 0  # by any of its rows
                start, count, key = find_contexts(np.frombuffer(text, np.uint8), known, is_hot)
                if not len(start):
                    continue
                for a in range(0, len(start), step):
                    if not texts or texts[-1] is not text:
                        texts.append(text)
                        base, bytes_of = bytes_of, bytes_of + len(text)
                    some = start[a : a + step]
                    group.append((np.full(len(some), d), some + base, some, count[a : a + step], key[a : a + step]))
                    size += 150 * len(some)
                    if max(size, bytes_of) >= group_bytes:
                        yield flush(texts, group)
                        texts, group, size, bytes_of = [], [], 0, 0
        if group:
            yield flush(texts, group)

    return run


def ranks_of(keys: np.ndarray) -> np.ndarray:
    """Names (from 1) of keys in their order."""
    order = np.argsort(keys)
    name = np.empty(len(keys), np.int64)
    own = keys[order]
    name[order] = np.cumsum(np.append(1, own[1:] != own[:-1]))
    return name


def triple_names(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the triples of s at the given places; s ends in three zeros."""
    bits = int(s.max()).bit_length()
    if 3 * bits <= 63:
        return ranks_of((s[at] << (2 * bits)) | (s[at + 1] << bits) | s[at + 2])
    pair = ranks_of((s[at + 1] << bits) | s[at + 2])  # names stay below 2**31: a sort takes BUCKET_BYTES, or one fingerprint's contexts
    return ranks_of((s[at] << int(pair.max()).bit_length()) | pair)


def sampled_ranks(s: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes of s[:n] at places 1 and 2 modulo 3, by their first depth symbols at least; 0 elsewhere."""
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)  # place n: the empty suffix, so that every place 0 has its next
    at = np.concatenate([one, two])
    name = triple_names(s, at)
    if depth > 3 and name.max() < len(name):
        r = np.concatenate([name[: len(one)], [0], name[len(one) :], [0, 0, 0]])
        deeper = suffix_ranks(r, len(at) + 1, -(-depth // 3))
        name = np.concatenate([deeper[: len(one)], deeper[len(one) + 1 : len(at) + 1]])
    out = np.zeros(len(s) + 3, np.int64)
    out[at] = name
    return out


def suffix_order(s: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Places of s[:n] in the order of their suffixes, by the first depth symbols at least; s ends in three zeros or more."""
    rank = sampled_ranks(s, n, depth)
    places = np.arange(n)
    one, two, zero = places[1::3], places[2::3], places[0::3]
    bits = max(int(rank.max()).bit_length(), 1)
    wide = int(s.max()).bit_length()
    if bits + 2 * wide > 63:  # name single symbols and pairs instead
        pair = ranks_of((s[:-1] << wide) | s[1:]) if 2 * wide <= 63 else None
        key1 = lambda i: (s[i] << bits) | rank[i + 1]
        key2 = lambda i: (pair[i] << bits) | rank[i + 2]
    else:
        key1 = lambda i: (s[i] << bits) | rank[i + 1]
        key2 = lambda i: (((s[i] << wide) | s[i + 1]) << bits) | rank[i + 2]
    sampled = np.concatenate([one, two])
    sampled = sampled[np.argsort(rank[sampled], kind="stable")]
    zero = zero[np.argsort(key1(zero), kind="stable")]
    before = np.searchsorted(np.sort(key1(one)), key1(zero)) + np.searchsorted(np.sort(key2(two)), key2(zero))
    order, is_zero = np.empty(n, np.int64), np.zeros(n, bool)
    spots = np.maximum.accumulate(before) + np.arange(len(zero))
    is_zero[spots] = True
    order[spots], order[~is_zero] = zero, sampled
    return order


def suffix_ranks(s: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Rank of every suffix of s[:n], equal where the first depth symbols are equal."""
    order = suffix_order(s, n, depth)
    same = np.ones(n - 1, bool)
    padded = np.concatenate([s, np.zeros(depth, s.dtype)])
    for k in range(depth):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.append(1, ~same))
    return rank


def repeated_starts(text: bytes, wanted: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which wanted starts (LENGTH bytes each, inside text) have their string also at a wanted start of a smaller document."""
    n = len(text)
    s = np.concatenate([np.frombuffer(text, np.uint8).astype(np.int64) + 1, np.zeros(LENGTH + 3, np.int64)])
    order = suffix_order(s, n, LENGTH)
    doc_at = np.full(n, -1, np.int64)
    doc_at[wanted] = np.arange(len(wanted))
    order = order[doc_at[order] >= 0]
    words = np.ndarray((n + 1,), "<u8", np.frombuffer(text + b"\0" * 8, np.uint8).data, strides=(1,))
    same = np.ones(len(order) - 1, bool)
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        same &= words[order[1:] + k] == words[order[:-1] + k]
    starts = np.flatnonzero(np.append(True, ~same))
    own = docs[doc_at[order]]
    least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(own))))
    out = np.zeros(len(wanted), bool)
    out[doc_at[order]] = own > least
    return out


REMOVED_DDL = "doc_id long, runs binary"
REMOVED = pa.schema([("doc_id", pa.int64()), ("runs", pa.binary())])


def merged_runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts (doc, start, stop) in order, those that touch or overlap as one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + count)[order]
    number = np.cumsum(np.append(False, doc[1:] != doc[:-1]))
    far = np.maximum.accumulate(number << 32 | stop)
    new = np.flatnonzero(np.append(True, (number[1:] << 32 | start[1:]) > far[:-1]))
    return doc[new], start[new], far[np.append(new, len(far))[1:] - 1] & 0xFFFFFFFF


def run_rows(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """One row per document: its runs (start, stop) as pairs of 32-bit numbers."""
    doc, start, stop = merged_runs(doc, start, count)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    offsets = (8 * np.append(first, len(doc))).astype(np.int32)
    pairs = np.stack([start, stop], 1).astype("<i4")
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(pairs)])], schema=REMOVED)


def sort_spot(doc: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, data: bytes, shift: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All contexts of some keys -> (doc, start, count) of the runs to remove; numbers without their last shift bits are doc_ids."""
    length = count + LENGTH - 1
    rows = context_rows(np.frombuffer(data + bytes(WIDE), np.uint8), np.cumsum(length) - length, length)
    order, new = by_content(rows, count, key, doc)
    doc, start, count = doc[order], start[order], count[order]
    which, own = np.cumsum(new) - 1, order[new]  # contexts, each once
    least = doc[new] >> shift
    whole = doc >> shift > least[which]
    found = [(doc[whole], start[whole], count[whole])]
    by_key = np.argsort(key[own], kind="stable")
    k = key[own][by_key]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    several = np.repeat(np.diff(np.append(first, len(k))) > 1, np.diff(np.append(first, len(k))))
    if several.any():
        sorted_ones = by_key[several]  # contexts by key: only those of one key can share a string
        k, size = k[several], length[own][sorted_ones]
        calls = np.cumsum(size) // BUCKET_BYTES
        calls = calls[np.flatnonzero(np.append(True, k[1:] != k[:-1]))[np.cumsum(np.append(0, k[1:] != k[:-1]))]]  # a key is in one call
        at = np.full(len(own), -1)
        at[sorted_ones] = np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1)
        gone = []
        for some in np.split(sorted_ones, np.flatnonzero(np.diff(calls)) + 1):
            n = length[own[some]]
            text = rows[own[some]][np.arange(WIDE) < n[:, None]].tobytes()
            n_starts = n - LENGTH + 1
            inside = np.arange(int(n_starts.sum())) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
            gone.append(repeated_starts(text, np.repeat(np.cumsum(n) - n, n_starts) + inside, np.repeat(least[some], n_starts)))
        gone = np.concatenate(gone)
        left = np.flatnonzero(~whole & (at[which] >= 0))  # the smallest document's own occurrences
        n = count[left]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = gone[np.repeat(at[which[left]], n) + inside]
        found.append((np.repeat(doc[left], n)[hit], (np.repeat(start[left], n) + inside)[hit], np.ones(int(hit.sum()), np.int64)))
    out = tuple(np.concatenate(c) for c in zip(*found, strict=True))
    return out if len(out[0]) else None


PARTS_DDL = "part int, docs binary, starts binary, stops binary"
PARTS = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()), ("stops", pa.binary())])


def part_rows(doc: np.ndarray, start: np.ndarray, count: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """Runs of starts, one row per part of the documents."""
    doc, start, stop = merged_runs(doc, start, count)
    part = (mix64(doc.astype(np.uint64)) % U64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
    rows = [(int(part[k[0]]), doc_blob(doc[k]), _blob(start[k], "<i4"), _blob(stop[k], "<i4")) for k in np.split(order, edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PARTS, strict=True)], schema=PARTS)


def gather_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by part of the documents -> one row per document with all its runs."""

    def whole(rows):
        doc = np.concatenate([doc_array(r[0], len(r[1]) // 4) for r in rows])
        starts, stops = (b"".join(r[c] for r in rows) for c in (1, 2))
        start = np.frombuffer(starts, "<i4").astype(np.int64)
        return run_rows(doc, start, np.frombuffer(stops, "<i4") - start)

    last, rows = None, []
    for batch in (s for b in batches for s in slices(b, 64)):
        for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != last and rows:
                yield whole(rows)
                rows = []
            last = part
            rows.append(row)
    if rows:
        yield whole(rows)


def sort_spots(n_parts: int, shift: int):
    """Contexts by spot -> per spot and part of the documents the runs of starts to remove."""

    def numbers(rows):
        doc = np.concatenate([doc_array(r[0], len(r[2])) for r in rows])
        starts, counts, keys, data = (b"".join(r[c] for r in rows) for c in range(1, 5))
        return doc, np.frombuffer(starts, "<i4").astype(np.int64), np.frombuffer(counts, "u1").astype(np.int64), np.frombuffer(keys, "<u4").astype(np.uint64), data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in (s for b in batches for s in slices(b, 64)):
            for spot, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if spot == -1:
                    yield part_rows(*numbers([row])[:3], n_parts)
                    continue
                if spot != last and rows:
                    if out := sort_spot(*numbers(rows), shift):
                        yield part_rows(*out, n_parts)
                    rows = []
                last = spot
                rows.append(row)
        if rows and (out := sort_spot(*numbers(rows), shift)):
            yield part_rows(*out, n_parts)

    return run


KEPT_DDL = "doc_id long, digest string, n_bytes long, spans array<struct<start:long,stop:long>>, kept_sha256 string"


def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text, runs) -> maximal removed runs and the digest of the bytes that stay."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string())])
    for batch in (s for b in batches for s in slices(b, 64)):
        out = []
        for d, digest, text, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
            runs = np.frombuffer(blob, "<i4").astype(np.int64).reshape(-1, 2)
            _, first, stop = merged_runs(np.zeros(len(runs), np.int64), runs[:, 0], runs[:, 1] - runs[:, 0] + LENGTH - 1)
            kept, at = hashlib.sha256(), 0
            for a, b in zip(first.tolist(), stop.tolist(), strict=True):
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out.append({"doc_id": d, "digest": digest, "n_bytes": len(text), "spans": [{"start": a, "stop": b} for a, b in zip(first.tolist(), stop.tolist(), strict=True)], "kept_sha256": kept.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (start, stop: maximal runs of removed bytes), kept_sha256.

    A byte goes if a 50-byte string over it also starts in a document of smaller
    doc_id, judged on whole input texts in UTF-8. Null texts are empty. Rows that
    repeat a doc_id, with one text or several, do not remove each other's strings. Rows without doc_id are
    left out; other columns are ignored; an empty table gives no rows. Where a doc_id has up to 2^b
    different texts that no smaller one has, doc_ids of 2^(63 - b) and more raise.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = doc_rows(docs)
    digests = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    firsts = cut(digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("n_bytes").alias("n_bytes")), "firsts", lean=True)
    # Every distinct text has a number: its first doc_id, and behind it as many bits as doc_ids with several such texts need.
    several, low, high = firsts.groupBy("first_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.min("first_id"), F.max("first_id")).first()
    shift = ((several or 1) - 1).bit_length()
    if shift and not -(1 << 63 - shift) <= low <= high < 1 << 63 - shift:
        raise ValueError(f"doc_ids with several texts leave room for {63 - shift} bits")
    nth = F.row_number().over(Window.partitionBy("first_id").orderBy("digest")) - 1 if shift else F.lit(0)
    texts = firsts.select(F.col("first_id").alias("doc_id"), "digest", (F.shiftleft("first_id", shift) + nth).alias("number"))
    texts = cut(texts, "texts") if shift else texts
    own = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    own = own.where(F.octet_length("text") >= LENGTH)
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(parts, total // (16 * BUCKET_BYTES) + 1)
    sent = own.select("text").mapInArrow(send_fingerprints(n_buckets, GROUP_BYTES), FLAGS_DDL)
    spot = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.xxhash64("docs"))
    repeated = sent.repartition(n_buckets, spot).sortWithinPartitions("bucket").mapInArrow(find_repeated(HOT_GROUPS), REPEATED_DDL)
    repeated = cut(repeated, "repeated", lean=True)
    named = F.col("name").isNotNull()
    n_fps, n_hot = (x or 0 for x in repeated.agg(F.sum(F.when(named, F.octet_length("fps") / 8)), F.count_if(~named)).first())
    flagged = repeated.where(named).select("name", "fps", "hot")
    if n_hot:
        hot = cut(repeated.where(~named).select("name", "fps").mapInArrow(single_fingerprints, SINGLE_DDL).select("fps"), "hot", lean=True)
        late = repeated.where(named & ~F.col("sent")).select("name", "fps").mapInArrow(single_fingerprints, SINGLE_DDL).join(hot, "fps")
        flagged = flagged.unionByName(late.select("name", "fps", F.unhex(F.lit("01")).alias("hot")))
    per_text = flagged.groupBy("name").agg(F.collect_list("fps").alias("fps"), F.collect_list("hot").alias("hot"))
    n_spots = int(max(parts, n_fps * 100 // (8 * BUCKET_BYTES) + 1))
    # Only the first document of each text needs the search, so its text is shuffled once, by document.
    name = F.conv(F.substring("digest", 1, 16), 16, -10).cast("long")
    searched = per_text.join(texts.withColumn("name", name), "name").drop("name")
    contexts = own.join(searched, ["doc_id", "digest"]).select("number", "text", "fps", "hot").mapInArrow(send_contexts(n_spots, GROUP_BYTES, shift), CONTEXTS_DDL)
    spot = F.when(F.col("spot") >= 0, F.col("spot")).otherwise(F.xxhash64("docs"))
    removed = cut(contexts.repartition(n_spots, spot).sortWithinPartitions("spot").mapInArrow(sort_spots(n_spots, shift), PARTS_DDL), "removed", lean=True)
    forget(repeated)
    runs = removed.repartition(n_spots, "part").sortWithinPartitions("part").mapInArrow(gather_runs, REMOVED_DDL)
    # A text that is not its doc_id's first is a copy, whose runs do not count; so one text a doc_id needs no more than that to meet its runs.
    runs = runs.withColumnRenamed("doc_id", "number").join(texts, "number").drop("number") if shift else runs
    changed = own.join(runs, ["doc_id", "digest"] if shift else "doc_id").select("doc_id", "digest", "text", "runs").mapInArrow(cover, KEPT_DDL).drop("n_bytes")
    known = digests.join(firsts.select("digest", "first_id"), "digest").select("doc_id", "digest", "n_bytes", (F.col("doc_id") > F.col("first_id")).alias("copy"))
    done = known.join(changed.dropDuplicates(["doc_id", "digest"]), ["doc_id", "digest"], "left")
    whole = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    spans = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>")))
    return done.select("doc_id", "n_bytes", spans.alias("spans"), F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))
