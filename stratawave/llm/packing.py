"""Packing documents into sequences: shortest-pack-first over the histogram of piece lengths.

Tokenising tasks number the pieces of each length they see. The histogram (at
most max_len bins) is packed on the driver: lengths go longest first, each into
the shortest packs it fits, counting patterns, not documents. Pieces then find
their pattern by rank: their task's offset for the length plus their number.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, cut, doc_rows, ship, slices


class WordTokenizer:
    """A tokenizers file applied part by part: parts between white space do not influence each other.

    That holds for tokenizers that drop white space and look at single
    characters and words. Arrow cuts and numbers the parts of many texts at
    once, so that Python meets each distinct part once per batch. A text with a
    character of which expressions disagree whether it is white space (U+001C
    to U+001F) is not cut, nor is one that spells a special token, which the library takes for that token.
    """

    #: Parts of which the ids are remembered, about; when that many are known, new ones are encoded for their batch alone.
    PARTS = 400_000
    #: Share of a batch's parts that may be new to a full memory before it starts anew.
    NEW = 0.25

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        # Special tokens written out in a text are special to the library, in any part of it and in this case alone.
        special = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(["[\x1c-\x1f]", *special]), re.IGNORECASE).search
        self.marks = re.compile("[\u0300-\U0010ffff]").search
        self.clear()

    def clear(self) -> None:
        """Empty the memory: part -> number; all ids, and where those of each number end."""
        self.parts: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ready(self, text: str) -> str:
        """The text in lower case, if no character of it can combine with another, which then changes no ids."""
        return text if self.marks(text) else text.lower()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text."""
        whole = {i: np.array(self.lib.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if self.odd(t)}
        cut = pc.utf8_split_whitespace(pa.array(["" if i in whole else self.ready(t) for i, t in enumerate(texts)], pa.string()))
        coded = cut.flatten().dictionary_encode()
        names, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        number = np.fromiter(map(self.parts.get, names, repeat(-1)), np.int64, len(names))
        if len(self.parts) >= self.PARTS and (number[place] < 0).mean() > self.NEW:
            self.clear()
            number[:] = -1
        missing = np.flatnonzero(number < 0)
        number[missing] = np.arange(len(self.parts), len(self.parts) + len(missing))
        new = [names[i] for i in missing.tolist()]
        found = [e.ids for e in self.lib.encode_batch_fast(new, add_special_tokens=False)]
        flat = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32)])
        ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        if len(self.parts) < self.PARTS:
            self.parts.update(zip(new, range(len(self.parts), len(self.parts) + len(new)), strict=True))
            self.ids, self.ends = flat, ends
        first, n = ends[number][place], np.diff(ends)[number][place]
        stop = np.append(0, np.cumsum(n))
        out = flat[np.repeat(first - stop[:-1], n) + np.arange(stop[-1])]
        edges = stop[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return [whole.get(i, out[a:b]) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def with_end(ids: np.ndarray, end_id: int) -> np.ndarray:
    return np.append(ids, np.uint32(end_id))


PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, number long"
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int32()), ("number", pa.int64())])


def cut_pieces(docs: DataFrame, path: str, max_len: int, end_id: int) -> DataFrame:
    """Pieces of every document (its ids, then end_id): full ones of max_len and one for the rest.

    task and number tell which piece of its length it is among those of its task.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, t = TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64), tokenizer(path)
        for batch in (s for b in batches for s in slices(b, 2048)):
            docs, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for doc, ids in ((docs[i], x) for a, b in by_bytes(texts, 8 << 20) for i, x in enumerate(t.encode_batch(texts[a:b]), a)):
                ids = with_end(ids, end_id)
                for a in range(0, len(ids), max_len):
                    part = ids[a : a + max_len]
                    out.append((doc, a, len(part), zlib.crc32(part), len(ids), task, int(seen[len(part)])))
                    seen[len(part)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    return doc_rows(docs).mapInArrow(run, PIECES_DDL)


def pack_histogram(counts: dict[int, int], max_len: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, first sequence, how many, offset) for counts[length] pieces of each length.

    Lengths longest first, each to the shortest packs that it fits; packs with
    the same contents are one entry (a run of sequence numbers) and are split
    when fewer pieces than packs are left.
    """
    slots, packs, sequences = [], [], 0  # packs: (filled, first sequence, how many)
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and packs and packs[0][0] + length <= max_len:
            filled, first, many = heapq.heappop(packs)
            used = min(many, left)
            slots.append((length, rank, first, used, filled))
            if used < many:
                heapq.heappush(packs, (filled, first + used, many - used))
            heapq.heappush(packs, (filled + length, first, used))
            rank, left = rank + used, left - used
        if left:
            slots.append((length, rank, sequences, left, 0))
            heapq.heappush(packs, (length, sequences, left))
            sequences += left
    return slots


def place_pieces(pieces: DataFrame, max_len: int) -> DataFrame:
    """pieces (with task and number; a table that gives the same rows each time) plus sequence_id and offset."""
    spark = pieces.sparkSession
    ship(spark)
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most max_len rows
    slots = np.array(sorted(pack_histogram({r["length"]: r["n"] for r in histogram}, max_len)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(slots)  # bounded by max_len, not by the number of documents
    schema = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        keys = own[:, 0] << 40 | own[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            sequence = own[at, 2] + rank - own[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in list(PIECES)[:5]), pa.array(sequence), pa.array(own[at, 4])], schema=schema)

    ranked = pieces.join(offsets, ["length", "task"]).select(*PIECES.names[:5], (F.col("number") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty (one piece with end_id alone); rows without doc_id are
    left out; repeated rows are packed each. An empty table gives no rows.
    Fewer than 2**40 pieces may have one length.
    """
    return place_pieces(cut(cut_pieces(docs, path, max_len, end_id), "pieces"), max_len)


def sequences(docs: DataFrame, placed: DataFrame, path: str, max_len: int = 2048, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (padded to max_len unless as long as a power of two), for docs with one row per doc_id."""
    ship(docs.sparkSession)
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in (s for b in batches for s in slices(b, 256)):
            out = []
            for places, ids in zip(batch.column("places").to_pylist(), t.encode_batch(batch.column("text").to_pylist()), strict=True):
                ids = with_end(ids, end_id).astype(np.int32)
                out += [(p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]]) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(seq, parts):
            ids = np.concatenate(parts)
            pad = 0 if len(ids) & (len(ids) - 1) == 0 else max_len - len(ids)
            return {"sequence_id": seq, "ids": np.append(ids, np.full(pad, pad_id, np.int32))}

        seq, parts = None, []
        out_schema = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in (s for b in batches for s in slices(b)):
            done = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if own != seq and parts:
                    done.append(row(seq, parts))
                    parts = []
                seq = own
                parts.append(ids.values.to_numpy())
            if done:
                yield pa.RecordBatch.from_pylist(done, out_schema)
        if parts:
            yield pa.RecordBatch.from_pylist([row(seq, parts)], out_schema)

    places = placed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("places"))
    pieces = doc_rows(docs).join(places, "doc_id").mapInArrow(tokens, "sequence_id long, offset long, ids array<int>")
    return pieces.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(joined, "sequence_id long, ids array<int>")
