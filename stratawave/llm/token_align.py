"""Cross-tokenizer alignment: cut groups of two tokenizers' tokens and links between overlapping ones, as joins and windows.

Tokens are exploded with their places, running sums of lengths give their ends,
and both sides meet on (key, end), which gives one row per distinct end: a stretch of bytes
that lies in one token of either side, that is, one link. Read from the last
end backwards, the last id seen on a side is the token a stretch lies in, and
the running count of ends of both sides numbers the groups. So links are as many as
ends, and no group lists pairs to find them.

Texts repeat words. align_documents cuts every text where both tokenizers must
have a boundary, aligns each distinct part of the corpus once by those joins,
and puts documents together again from the parts of their block, a few MB of
whole documents with its own dictionary; what is shuffled are dictionaries
and numbers instead of every token.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, doc_rows, forget, ship

#: Bytes of text in a block, about (a longer document stands alone).
BLOCK = 16 << 20
#: Codes of a block that are worked on at once, about.
CHUNK = 1 << 20


# ---- the relational core


def token_ends(rows: DataFrame, key: str) -> DataFrame:
    """key, side, id, end: one row a token of rows (key, a_ids, a_lengths, b_ids, b_lengths), end from the running sum of lengths on its side."""

    def tokens(side: str) -> Column:
        return F.transform(F.arrays_zip(F.col(f"{side}_ids").alias("id"), F.col(f"{side}_lengths").alias("length")), lambda t: F.struct(F.lit(side).alias("side"), t["id"].alias("id"), t["length"].alias("length")))

    t = rows.select(key, F.posexplode(F.concat(tokens("a"), tokens("b"))).alias("pos", "t")).select(key, "pos", "t.*")
    before = Window.partitionBy(key, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select(key, "side", "id", F.sum("length").over(before).cast("int").alias("end"))


def links(tokens: DataFrame, key: str) -> DataFrame:
    """key, end, a, b, a_ends, b_ends, group of token_ends' rows, one row a link; groups count from the last to the first.

    The full equi-join of both sides on (key, end) is written as one grouping of
    their union: dealt by key once, the tokens then need no other exchange.
    """
    later = Window.partitionBy(key).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("id"))).alias(side)
    both = tokens.groupBy(key, "end").agg(of("a"), of("b"))
    a_ends, b_ends = F.col("a").isNotNull(), F.col("b").isNotNull()
    within = lambda c: F.last(c, ignorenulls=True).over(later).alias(c)
    return both.select(key, "end", within("a"), within("b"), a_ends.alias("a_ends"), b_ends.alias("b_ends"), F.count(F.when(a_ends & b_ends, 1)).over(later).alias("group"))


def aligned(rows: DataFrame, key: str) -> DataFrame:
    """key, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`), pairs (a * 2^32 + b of each link) of links' rows."""

    def ids(side: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col(f"{side}_ends"), F.struct("end", side))))
        return F.array_join(F.transform(own, lambda t: t[side].cast("string")), ",")

    n = lambda c: F.count(F.when(F.col(c), 1)).alias(f"n_{c[0]}")
    pair = F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")
    groups = rows.groupBy(key, "group").agg(F.max("end").alias("end"), n("a_ends"), n("b_ends"), F.concat(ids("a"), F.lit("|"), ids("b")).alias("text"), F.collect_list(pair).alias("pairs"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("end", "text"))), lambda g: g["text"]), ";")
    return groups.groupBy(key).agg(F.sum("n_a").cast("int").alias("n_a"), F.sum("n_b").cast("int").alias("n_b"), F.count("*").cast("int").alias("n_groups"), text.alias("groups"), F.flatten(F.collect_list("pairs")).alias("pairs"))


# ---- tokenizers

#: Appended to a model, this message is merged into it: normalizer_spec (3) { add_dummy_prefix (3): false }.
NO_PREFIX = b"\x1a\x02\x18\x00"


def byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves, the rest from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, given bytes that begin where a token must: space + text, or a part of it."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        with open(piece_file, "rb") as f:
            self.b = sentencepiece.SentencePieceProcessor(model_proto=f.read() + NO_PREFIX)
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(True).items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int]]]:
        """ids and byte lengths of both sides; all empty where the bytes of a side are not those of the text."""
        first = self.a.encode_batch_fast(texts, add_special_tokens=False)
        for text, one, b in zip(texts, first, self.b.encode(texts, num_threads=1), strict=True):
            a, raw = one.ids, text.encode()
            own, other = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
            yield (a, [*map(len, own)], b, [*map(len, other)]) if b"".join(own) == raw == b"".join(other) else ([], [], [], [])


_LOADED: dict[tuple[str, str], Pair] = {}


def loaded(byte_file: str, piece_file: str) -> Pair:
    """The pair, once a worker."""
    key = byte_file, piece_file
    if key not in _LOADED:
        _LOADED[key] = Pair(*key)
    return _LOADED[key]


def cuts_are_safe(byte_file: str, piece_file: str) -> bool:
    """Whether boundaries() holds for these files: the byte side splits words by the usual pattern, and no piece goes past a boundary."""
    with open(byte_file, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or spec["model"].get("ignore_merges"):
        return False
    pair = loaded(byte_file, piece_file)
    pieces = (p for i, p in enumerate(map(pair.b.id_to_piece, range(pair.b.get_piece_size()))) if not (pair.b.is_byte(i) or pair.b.is_control(i) or pair.b.is_unknown(i)))
    return not any(re.search(r"[^▁]▁|[A-Za-z\xc0-\xff][\n!-&(-/:-@\[-`{-~]", p) for p in pieces)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places of UTF-8 bytes where every word ends for both tokenizers: a space after what is no white space, or ASCII punctuation (no apostrophe) or a line feed after a Latin letter."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    here, one = data[1:], data[:-1]
    two = np.concatenate([[0], data[:-2]]).astype(np.uint8)
    three = np.concatenate([[0, 0], data[:-3]]).astype(np.uint8)[: len(one)]
    # No byte that can end a wide white space: U+0085, U+00A0, U+1680, U+2000 to U+203F, U+205F, U+3000.
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE2) & ((two == 0x80) | ((two == 0x81) & (one == 0x9F)))) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    visible = (one > 0x20) & (one != 0x7F) & ~wide
    letter = ((one | 0x20) >= 0x61) & ((one | 0x20) <= 0x7A) & (one < 0x80) | ((two == 0xC3) & (one >= 0x80) & (one < 0xC0) & (one != 0x97) & (one != 0xB7))
    return np.flatnonzero(((here == 0x20) & visible) | (_MARKS[here] & letter)) + 1


_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"] + [0x0A]] = True


# ---- documents


BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.list_(pa.int32())), ("code", pa.int32()), ("part", pa.string())])
BLOCKS_DDL = "block long, doc_id long, codes array<int>, code int, part string"


def block_of(ids: pa.Array, texts: pa.Array, block: int, safe: bool) -> Iterator[pa.RecordBatch]:
    """A block's rows: a document with the codes of its parts, or a part with its code."""
    raw = texts.cast(pa.large_binary())
    joined = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), raw, pa.scalar(b"", pa.large_binary()))
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    starts = np.unique(np.concatenate([ends, boundaries(data)] if safe else [ends])).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
    full = np.diff(ends) > 1  # the space alone: an empty text, which has no parts
    place, codes = np.searchsorted(starts, ends), parts.indices.to_numpy()
    held = np.ones(len(codes), bool)
    held[place[:-1][~full]] = False
    sizes = np.where(full, np.diff(place), 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(codes[held], pa.int32()))
    n, m = len(ids), len(parts.dictionary)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), ids, lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=BLOCKS)
    for at in range(0, m, 10_000):
        part = parts.dictionary[at : at + 10_000].cast(pa.string())
        k = len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(at, at + k), pa.int32()), part], schema=BLOCKS)


def blocks(docs: DataFrame, safe: bool, size: int) -> DataFrame:
    """Documents by blocks of whole documents, numbered by task; to be written before use."""

    def run(batches):
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy()
            at = 0
            for i, n in enumerate(lengths.tolist()):
                if held and held + n > size:
                    if i > at:
                        ids.append(batch.column(0)[at:i])
                        texts.append(batch.column(1)[at:i])
                    yield from block_of(pa.concat_arrays(ids), pa.concat_arrays(texts), number, safe)
                    number, ids, texts, held, at = number + 1, [], [], 0, i
                held += n
            ids.append(batch.column(0)[at:])
            texts.append(batch.column(1)[at:])
        if ids and sum(map(len, ids)):
            yield from block_of(pa.concat_arrays(ids), pa.concat_arrays(texts), number, safe)

    return doc_rows(docs).mapInArrow(run, BLOCKS_DDL)


ENCODED = pa.schema([("part_id", pa.int64()), ("part", pa.string()), *[(f"{side}_{what}", pa.list_(pa.int32())) for side in "ab" for what in ("ids", "lengths")]])
ENCODED_DDL = "part_id long, part string, a_ids array<int>, a_lengths array<int>, b_ids array<int>, b_lengths array<int>"


def encoded(parts: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """part -> ENCODED, numbered by task; to be written before use."""

    def run(batches):
        pair, number = loaded(byte_file, piece_file), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                own = batch.column(0)[at : at + 2048]
                cols = zip(*pair.encode(own.to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(own))), own, *[pa.array(c, pa.list_(pa.int32())) for c in cols]], schema=ENCODED)
                number += len(own)

    return parts.mapInArrow(run, ENCODED_DDL)


def align_parts(parts: DataFrame) -> DataFrame:
    """ENCODED -> part, n_a, n_b, n_groups, groups, pairs, by the relational core; parts without tokens are not there."""
    found = aligned(links(token_ends(parts.drop("part").repartition("part_id"), "part_id"), "part_id"), "part_id")
    return found.join(parts.select("part_id", "part"), "part_id").drop("part_id")


class Block:
    """A block in arrays: its documents' codes and its parts' pairs, both as runs."""

    def __init__(self, docs: pa.Table, parts: pa.Table) -> None:
        docs = docs.combine_chunks()
        codes = docs["codes"].combine_chunks()
        codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
        self.ids, self.sizes = docs["doc_id"].to_numpy(), codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes = codes.flatten().to_numpy(zero_copy_only=False)
        own = parts.filter(pc.is_valid(parts["code"])).sort_by("code").combine_chunks()
        self.parts, self.n = own, own.num_rows
        self.known = pc.is_valid(own["n_a"]).to_numpy().astype(bool)
        pairs = own["pairs"].combine_chunks()
        pairs = pairs.chunk(0) if isinstance(pairs, pa.ChunkedArray) and pairs.num_chunks else pairs
        self.pair_sizes = np.where(self.known, pc.fill_null(pc.list_value_length(pairs), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.pairs = pc.list_flatten(pairs).to_numpy(zero_copy_only=False) if self.n else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        # A text with a part whose bytes come back differently has no tokens.
        self.good = self.sums(~self.known[self.codes] if self.n else np.zeros(0, bool), self.sizes) == 0

    @staticmethod
    def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def chunks(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents with about CHUNK codes."""
        a = 0
        while a < len(self.sizes):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + CHUNK, "right")) - 1)
            yield a, b
            a = b


def count_pairs(docs: pa.Table, parts: pa.Table) -> pa.Table:
    """block, pair, n: in how many documents of a block a pair is linked."""
    b = Block(docs, parts)
    pairs, inner = np.unique(b.pairs, return_inverse=True)
    counts, firsts = np.zeros(len(pairs), np.int64), np.cumsum(b.pair_sizes) - b.pair_sizes
    for lo, hi in b.chunks():
        own = np.repeat(np.arange(hi - lo), b.sizes[lo:hi])
        codes = b.codes[b.starts[lo] : b.starts[hi]]
        keep = b.good[lo:hi][own]
        hits = np.unique(own[keep] * b.n + codes[keep])
        if not len(hits):
            continue
        doc, code = np.divmod(hits, b.n)
        n = b.pair_sizes[code]
        at = np.repeat(firsts[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        counts += np.bincount(np.unique(np.repeat(doc, n) * len(pairs) + inner[at]) % len(pairs), minlength=len(pairs))
    seen = counts > 0
    block = docs["block"][0].as_py() if docs.num_rows else 0
    return pa.table({"block": pa.array(np.full(seen.sum(), block)), "pair": pa.array(pairs[seen]), "n": pa.array(counts[seen])})


RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def fold_documents(docs: pa.Table, parts: pa.Table) -> pa.Table:
    """Documents of a block from its parts (rows with a code) and its pairs (rows with a pair, its count and whether it is its A id's best)."""
    b = Block(docs, parts)
    rows = parts.filter(pc.is_valid(parts["pair"])).sort_by("pair")
    known, count, best = (rows[c].to_numpy() for c in ("pair", "count", "best"))
    at = np.minimum(np.searchsorted(known, b.pairs), max(len(known) - 1, 0))
    there = known[at] == b.pairs if len(known) else np.zeros(len(b.pairs), bool)  # pairs of texts without tokens have no count
    of_pairs = lambda values: b.sums(np.where(there, values[at], 0) if len(known) else np.zeros(len(b.pairs)), b.pair_sizes)
    per_part = {k: np.where(b.known, pc.fill_null(b.parts[k], 0).to_numpy(), 0) if b.n else np.zeros(0) for k in ("n_a", "n_b", "n_groups")}
    per_part |= {"n_links": b.pair_sizes, "n_best": of_pairs(best.astype(np.int64)), "count_sum": of_pairs(count)}
    out = {k: np.where(b.good, b.sums(v[b.codes] if b.n else np.zeros(0), b.sizes), 0).astype(np.int64) for k, v in per_part.items()}
    texts, digests = b.parts["groups"].combine_chunks(), []
    for lo, hi in b.chunks():
        codes = pa.array(b.codes[b.starts[lo] : b.starts[hi]])
        taken = texts.take(codes) if b.n else pa.array([], pa.string())
        taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
        lists = pa.ListArray.from_arrays(pa.array(b.starts[lo : hi + 1] - b.starts[lo], pa.int32()), taken)
        for text, good, n in zip(pc.binary_join(lists, ";"), b.good[lo:hi], b.sizes[lo:hi], strict=True):
            digests.append(hashlib.sha256(text.as_buffer()).hexdigest() if good and n else "")
    return pa.table({"doc_id": pa.array(b.ids), **{k: pa.array(v) for k, v in out.items()}, "groups_sha256": pa.array(digests, pa.string())})


def align_documents(docs: DataFrame, byte_file: str, piece_file: str, block_bytes: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    byte_file: a byte-level vocabulary of the tokenizers library (A, given space +
    text); piece_file: a sentencepiece model (B, which puts the space there itself).
    Null and empty texts, and those whose bytes a side does not give back, have
    no tokens: zeros and ''. Repeated rows are returned each and count each as
    a document; rows without doc_id are left out; other columns are ignored; an empty
    table gives no rows. Vocabularies for which boundaries() does not hold are
    aligned by whole texts.
    """
    ship(docs.sparkSession)
    safe = cuts_are_safe(byte_file, piece_file)
    held = cut(blocks(docs, safe, block_bytes), "blocks", lean=True)
    own = held.where("codes is not null").select("block", "doc_id", "codes")
    words = held.where("part is not null").select("block", "code", "part")
    parts = cut(encoded(words.select("part").distinct(), byte_file, piece_file), "parts", lean=True)
    known = cut(words.join(align_parts(parts), "part", "left").drop("part"), "known", lean=True)
    forget(parts)
    found = cut(own.groupBy("block").cogroup(known.select("block", "code", "n_a", "pairs").groupBy("block")).applyInArrow(count_pairs, "block long, pair long, n long"), "pairs", lean=True)
    a = F.shiftrightunsigned("pair", 32)
    counts = found.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(a)))  # at most one row a B id
    scored = found.select("block", "pair").join(counts, "pair")
    out = cut(own.groupBy("block").cogroup(known.unionByName(scored, allowMissingColumns=True).groupBy("block")).applyInArrow(fold_documents, RESULT_DDL), "aligned", lean=True)
    forget(held, known, found)
    return out
