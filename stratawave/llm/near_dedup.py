"""MinHash near-dedup: banded candidates, checked by odd sketches, confirmed on full shingle sets.

Documents with equal shingle sets are one class from the start. Each class then
meets one pivot, the member of its band buckets that most others share buckets
with, so that most of a group joins its middle at once. Buckets that still hold
several components are dealt into cells of bounded size. A first look at the
sketches tells which members have a candidate of another component at all; only
these bring their shingle sets. Cells decide candidates on the sets and give
back links that join components, fewer than they have members, not pairs. A cell
compares only what lies outside the bucket's largest component with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, doc_rows, forget, mix64, ship, slices, weighed

WORDS = 5
#: 60 bands of 6: a pair of similarity 0.75 shares none with probability 8e-6.
BANDS, ROWS = 60, 6
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS
#: Pairs linked: 100 * intersection >= 75 * union.
PERCENT = 75
#: Sketch estimates below this are no candidates: 4.5 standard errors (0.028: 0.023 of the samples, 0.016 of the sketch) under the threshold.
ESTIMATE = 0.625
#: Members, and shingles of members, that a cell takes from either of its two chunks, at most about.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000

_rng = np.random.default_rng(20240501)
FACTORS = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * U64(2) + U64(1)
PLACE = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * U64(2) + U64(1)
WORD_BASE = U64(0x9E3779B97F4A7C15)
ORDER = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)


def max_difference(estimate: float) -> int:
    """Differing sketch bits at most, for an estimated similarity of at least estimate: z = n/2 (1 - exp(-4k(1-J)/n))."""
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - estimate) / SKETCH_BITS)))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, text after text, and how many each has.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D;
    a text of fewer than WORDS words has all of them as its one shingle.
    """
    none = np.zeros(0, np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    if not texts:
        return none, np.zeros(0, np.int64)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none, np.zeros(len(texts), np.int64)
    lengths = np.diff(np.append(starts, len(buf)))
    inside = np.arange(starts[0], len(buf)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, WORD_BASE, np.uint64))
    parts = powers[inside] * (buf[starts[0] :].astype(np.uint64) + U64(1))
    parts[blank[starts[0] :]] = 0
    word = mix64(np.add.reduceat(parts, starts - starts[0]))
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    counts = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(counts)
    combined = np.zeros(max(len(word) - WORDS + 1, 0), np.uint64)
    for j in range(WORDS):
        combined += word[j : j + len(combined)] * ORDER[j]
    combined = mix64(combined)
    out, n = [], np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(counts):
        a, b = ends[i] - counts[i], ends[i]
        if counts[i] >= WORDS:
            own = np.unique(combined[a : b - WORDS + 1])
        else:
            own = mix64(np.array([(word[a:b] * ORDER[: b - a]).sum() + U64(counts[i])], np.uint64))
        out.append(own)
        n[i] = len(own)
    return np.concatenate(out), n


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x BANDS) and odd sketches (sets x SKETCH_WORDS) of nonempty sets."""
    starts = np.cumsum(sizes) - sizes
    low = np.empty((SAMPLES, len(sizes)), np.uint64)
    for i in range(SAMPLES):
        low[i] = np.minimum.reduceat(hashes * FACTORS[i], starts)
    keys = np.zeros((len(sizes), BANDS), np.uint64)
    for b in range(BANDS):
        own = np.full(len(sizes), U64(b + 1))
        for j in range(b * ROWS, (b + 1) * ROWS):
            own = mix64(own * ORDER[0] + low[j])
        keys[:, b] = own
    sketch = np.zeros((len(sizes), SKETCH_WORDS), np.uint64)
    rows = np.arange(len(sizes))
    for i in range(SAMPLES):  # each sample flips the bit that its number and value hash to
        bit = mix64(low[i] ^ PLACE[i]) % U64(SKETCH_BITS)
        sketch[rows, (bit >> U64(6)).astype(np.int64)] ^= U64(1) << (bit & U64(63))
    return keys, sketch


FEATURES_DDL = "doc_id long, n_shingles long, set_hash binary, keys array<long>, sketch array<long>"
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def features(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, and for nonempty sets a 128-bit hash of the set, its band keys and its odd sketch."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in weighed(b, 1)):
            hashes, n = shingle_sets([t.as_py() for t in batch.column(1).cast(pa.binary())])
            full = np.flatnonzero(n)
            keys, sketch = signatures(hashes, n[full]) if len(full) else (np.zeros((0, BANDS), np.uint64), np.zeros((0, SKETCH_WORDS), np.uint64))
            place, ends, names = np.cumsum(n > 0) - 1, np.cumsum(n), []
            for i in range(len(n)):
                names.append(xxhash.xxh128_digest(hashes[ends[i] - n[i] : ends[i]].tobytes()) if n[i] else None)

            def lists(m):
                return pa.array([m[place[i]].view(np.int64) if n[i] else None for i in range(len(n))], pa.list_(pa.int64()))

            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(names, pa.binary()), lists(keys), lists(sketch)], schema=FEATURES)

    return doc_rows(docs).mapInArrow(run, FEATURES_DDL)


SETS_DDL = "doc long, n int, shingles binary"
SETS = pa.schema([("doc", pa.int64()), ("n", pa.int32()), ("shingles", pa.binary())])


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> doc, n, the hashes of its shingles in order."""
    for batch in (s for b in batches for s in weighed(b, 1)):
        hashes, n = shingle_sets([t.as_py() for t in batch.column(1).cast(pa.binary())])
        parts = [x.tobytes() for x in np.split(hashes, np.cumsum(n)[:-1])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(parts, pa.binary())], schema=SETS)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable over edges (a, b); nodes that are their own comp are left out.

    Alternates large stars and small stars until nothing changes; every step is a join and an aggregate.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if sign == state or not sign[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = sign
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, cut(small.where("u <> v").distinct(), "edges")
        forget(last)


def difference(a: str, b: str) -> Column:
    """Differing bits of two sketch columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are linked by their full sets (doc, n, shingles)."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 256)):
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                own, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(own, other, assume_unique=True))
                out.append(100 * both >= PERCENT * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(out, pa.bool_())) for c in batch.columns[:2]], schema=schema)

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(run, "a long, b long")


def with_comp(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps.select(F.col("node").alias("doc"), "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def cells(members: DataFrame) -> DataFrame:
    """Members (key, doc, n, comp) of buckets with several components, dealt into cells: key, i, j, first, chunk, doc, comp.

    Chunks 0..m-1 hold what is outside the bucket's largest component, chunks
    from m on that component; their number follows from what they hold. Cell
    (i, j), i < m, i < j, compares chunk i with chunk j, and if first, which is
    j = m, also the members of chunk i with each other. So a bucket with one
    chunk of either kind is one cell, and its members are not repeated.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("shingles"))
    buckets = sizes.groupBy("key").agg(F.sum("n").alias("total"), F.sum("shingles").alias("shingles"), F.count("*").alias("several"), F.max(F.struct("n", "comp", "shingles")).alias("top")).where("several > 1")
    chunks = lambda n, shingles: F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    buckets = buckets.select("key", F.col("top.comp").alias("top"), chunks(F.col("total") - F.col("top.n"), F.col("shingles") - F.col("top.shingles")).alias("minor"), chunks(F.col("top.n"), F.col("top.shingles")).alias("major"))
    own, hashed = members.join(buckets, "key"), F.xxhash64("doc")
    outside = F.col("comp") != F.col("top")
    own = own.withColumn("chunk", F.when(outside, F.pmod(hashed, F.col("minor"))).otherwise(F.col("minor") + F.pmod(hashed, F.col("major"))).cast("int"))
    one = own.where("minor = 1 and major = 1").withColumn("other", 1 - F.col("chunk"))
    several = own.where("minor > 1 or major > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("minor") + F.col("major")).otherwise(F.col("minor")) - 1)))
    dealt = one.unionByName(several).where("other <> chunk").withColumn("j", F.greatest("chunk", "other"))
    return dealt.select("key", F.least("chunk", "other").alias("i"), "j", (F.col("j") == F.col("minor")).alias("first"), "chunk", "doc", "comp")


def by_cell(columns: list[str], handle, schema: pa.Schema):
    """Rows in order of key, i, j (the first columns) -> what handle makes of each whole cell (a dict of columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def of(parts):
            rows = pa.Table.from_batches(parts)
            return handle({c: rows.column(c).combine_chunks() for c in columns})

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j = (batch.column(c).to_numpy() for c in range(3))
            edges = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(key)]
            if rest and tuple(rest[-1].column(c)[-1].as_py() for c in range(3)) != (key[0], i[0], j[0]):
                yield from of(rest)
                rest = []
            for a, b in zip(edges, edges[1:], strict=False):
                rest.append(batch.slice(a, b - a))
                if b < len(key):
                    yield from of(rest)
                    rest = []
        if rest:
            yield from of(rest)

    def filled(batches):
        for rows in run(batches):
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return filled


def candidates(cell: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of chunk i, rows that they meet, and the sketches' difference: more than SKETCH_BITS where the two are no candidates.

    Two members are candidates if their sketches and their set sizes allow a
    link, they are of different components, and this bucket is that of the first
    band in which they share a key (told by 31 bits of the keys: two keys of one
    band agree in these by chance with probability 5e-10).
    """
    chunk, comp, n = (cell[c].to_numpy() for c in ("chunk", "comp", "n"))
    sketch = cell["sketch"].flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)
    short = cell["short"].flatten().to_numpy().reshape(-1, BANDS)
    low = cell["key"][0].as_py() & 0x7FFFFFFF
    left, right = np.flatnonzero(chunk == cell["i"][0].as_py()), np.flatnonzero(chunk == cell["j"][0].as_py())
    if cell["first"][0].as_py():
        right = np.concatenate([left, right])
    z = np.zeros((len(left), len(right)), np.int32)
    for w in range(SKETCH_WORDS):
        z += np.bitwise_count(sketch[left, w][:, None] ^ sketch[right, w][None, :])
    small, large = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
    z[(comp[left][:, None] == comp[right]) | (z > max_difference(ESTIMATE)) | (100 * small < PERCENT * large)] = SKETCH_BITS + 1
    r, c = np.nonzero(z <= SKETCH_BITS)
    for a in range(0, len(r), 1 << 16):
        x, y = r[a : a + (1 << 16)], c[a : a + (1 << 16)]
        mine = short[left[x]]
        same = mine == short[right[y]]
        later = mine[np.arange(len(x)), same.argmax(1)] != low
        z[x[later], y[later]] = SKETCH_BITS + 1
    return left, right, z


def open_members(cell: dict) -> Iterator[tuple]:
    """The members of a cell that have a candidate in it."""
    left, right, z = candidates(cell)
    hits = z <= SKETCH_BITS
    rows = np.unique(np.concatenate([left[hits.any(1)], right[hits.any(0)]]))
    yield tuple(cell[c].take(pa.array(rows)) for c in OPEN.names)


def links(cell: dict) -> Iterator[tuple]:
    """Pairs that are linked by their full sets and join components of the cell, each with one already joined left out."""
    left, right, z = candidates(cell)
    doc, comp = cell["doc"].to_numpy(), cell["comp"].to_numpy()
    names, own = np.unique(comp, return_inverse=True)
    parent = np.arange(len(names))
    sizes = cell["n"].to_numpy().astype(np.int64)
    word = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in cell["shingles"]]), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(word.max()) + 1, bool)
    a, b = [], []

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r in np.flatnonzero((z <= SKETCH_BITS).any(1)):
        row = left[r]
        found = np.flatnonzero(z[r] <= SKETCH_BITS)
        found = right[found[np.argsort(z[r][found], kind="stable")]]
        mark[word[starts[row] : starts[row] + sizes[row]]] = True
        step = 8  # the nearest first: a link with them leaves little of the rest to decide
        while len(found):
            roots = np.array([root(x) for x in own[found]])
            found = found[roots != root(own[row])]
            some, found = found[:step], found[step:]
            if not len(some):
                continue
            inside = np.arange(int(sizes[some].sum())) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
            both = np.add.reduceat(mark[word[np.repeat(starts[some], sizes[some]) + inside]].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for x in some[100 * both >= PERCENT * (sizes[row] + sizes[some] - both)]:
                p, q = root(own[row]), root(own[x])
                if p != q:
                    parent[p] = q
                    a.append(doc[row])
                    b.append(doc[x])
            step = 64
        mark[word[starts[row] : starts[row] + sizes[row]]] = False
    yield a, b


OPEN_DDL = "key long, i int, j int, first boolean, chunk int, doc long, comp long"
OPEN = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("first", pa.bool_()), ("chunk", pa.int32()), ("doc", pa.int64()), ("comp", pa.int64())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id linked, itself included), kept.

    Two documents are linked if 100 * |both sets| >= 75 * |either set|; sets are
    those of shingle_sets over whole texts. Null, empty and blank texts have
    empty sets and are linked with nothing. Repeated rows are returned each, and
    rows of one doc_id with different texts are one document, linked with all
    that any of its texts is linked with. Rows without doc_id are left out; other
    columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    own = cut(features(docs), "features")
    full = own.where("n_shingles > 0")
    classes = cut(full.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.select(F.col("doc_id").alias("rep"), F.col("n_shingles").cast("int").alias("n"), "set_hash", "keys", "sketch").join(classes, ["rep", "set_hash"], "left_semi")
    reps = cut(reps.dropDuplicates(["rep", "set_hash"]).select(F.col("rep").alias("doc"), "n", "keys", "sketch"), "reps")
    entries = reps.select("doc", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    members = cut(entries.join(shared, "key"), "members")
    weights = members.groupBy("doc").agg(F.sum("many").alias("weight"))
    involved = cut(weights, "involved")
    short = F.transform("keys", lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    sketches = cut(reps.select("doc", "n", "sketch", short.alias("short")).join(involved, "doc", "left_semi"), "sketches")
    texts = doc_rows(docs).join(involved.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = cut(texts.mapInArrow(shingle_rows, SETS_DDL).where("n > 0"), "sets")

    # The pivot of a bucket is its member with the most companions over all its buckets; each document
    # goes with the pivot that it shares most buckets with. What this leaves apart the cells find.
    weighed = members.join(involved, "doc")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("doc").alias("h"), "doc")).alias("p")).select("key", F.col("p.doc").alias("pivot"))
    close = members.select("doc", "key").join(pivots, "key").where("doc <> pivot").groupBy(F.col("doc").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("n"))
    close = close.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    close = close.join(sketches.select(F.col("doc").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("doc").alias("b"), F.col("sketch").alias("sb")), "b")
    close = close.where(difference("sa", "sb") <= max_difference(ESTIMATE)).select("a", "b")
    star = cut(linked_pairs(close, sets).distinct(), "star")
    several = full.select("doc_id", "set_hash").join(classes, "set_hash").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("c"))
    met = star.unionByName(several.where("b <> c").select(F.col("c").alias("a"), "b"))
    comps = components(met)

    dealt = cells(with_comp(members.select("key", "doc", "n"), comps))
    order = ("key", "i", "j")
    looked = dealt.join(sketches, "doc").repartition(*order).sortWithinPartitions(*order).select(*OPEN.names, "n", "sketch", "short")
    found = cut(looked.mapInArrow(by_cell([*OPEN.names, "n", "sketch", "short"], open_members, OPEN), OPEN_DDL), "open")
    decided = found.join(sketches.drop("n"), "doc").join(sets, "doc").repartition(*order).sortWithinPartitions(*order)
    columns = [*OPEN.names, "n", "sketch", "short", "shingles"]
    new = cut(decided.select(*columns).mapInArrow(by_cell(columns, links, PAIR), "a long, b long").distinct(), "links")
    comps = components(met.unionByName(new))
    forget(star, new, found, sets, sketches, members, involved, reps)
    done = own.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    done = done.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    return done.select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"), (F.coalesce("comp", "rep") == F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one document of each group stays (the smallest doc_id), repeated rows once; rows without doc_id go.

    Groups are those of near_duplicates, so null, empty and blank texts stay, and an empty table gives no rows.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_id"], "left_semi").dropDuplicates(["doc_id", "text"])
