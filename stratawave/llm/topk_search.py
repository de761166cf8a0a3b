"""Exact top-k by inner product: pivot tables bound every score, candidates go in the order of their bounds.

Vectors are whole numbers, so scores are exact. With d the Euclidean distance,
<q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, and d(q, x) >= |d(q, p) - d(x, p)| for
each pivot p: precomputed distances to the pivots give an upper bound of each
score. Vectors are dealt to cells by their nearest pivot, once. A first pass
searches one cell of each query's own pivot; its k-th score then rules out the
pivots of which no vector can reach it, and a second pass searches the cells
left. In a cell candidates go by falling bound until the k-th best score is
above all bounds left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, slices

#: Vectors of one cell, at most about; queries stream past them.
CELL_VECTORS = 16_384
#: Vectors of smallest hash among which the pivots are sought, at most.
PIVOT_SAMPLE = 4_096
#: Pivots of the first bound, and of each round that refines it.
PIVOTS_AT_ONCE = 32


def whole_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (array<long>: floor(scale * x)); vectors null or with null or non-finite components, and rows without vec_id, are left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of one width; shorter vectors count as followed by zeros."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b."""
    a, b = a.astype(float), b.astype(float)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before it, as long as there is one apart from them."""
    chosen, far = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def number_cells(counts: list[int]) -> tuple[list[int], list[int]]:
    """First cell and number of cells of each pivot's vectors: small pivots share a cell, large ones are split over several."""
    start, many, cell, filled = [], [], 0, 0
    for n in counts:
        if filled and filled + n > CELL_VECTORS:
            cell, filled = cell + 1, 0
        start.append(cell)
        many.append(max(1, -(-n // CELL_VECTORS)))
        cell, filled = cell + many[-1] - 1, (filled + n if many[-1] == 1 else CELL_VECTORS)
    return start, many


class Cell:
    """The vectors of a cell with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.pivots = ids[order], x[order], pivots
        self.squares = (self.x * self.x).sum(1).astype(float)
        self.far = distances(self.pivots, self.x)
        # Whole numbers below 2**53 are exact as floats, and fast.
        self.exact = self.x.astype(float) if max(self.squares.max(), 1) < 2**40 else self.x
        self.evaluated = 0

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.evaluated += len(at)
        fast = self.exact is not self.x and float((q * q).sum()) < 2**60  # by Cauchy-Schwarz every partial sum is below 2**53
        x, q = (self.exact, q.astype(float)) if fast else (self.x, q)
        # Most of the cell: one product over all of it is cheaper than picking rows.
        return ((x @ q)[at] if 2 * len(at) > len(x) else x[at] @ q).astype(np.int64)

    def search(self, own: int, q: np.ndarray, k: int, floor: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best candidates that reach floor, by score then vec_id, leaving out the query's own vec_id.

        The best by the first pivots' bound are evaluated at once and raise the
        floor; more pivots refine the bounds of those left while each round of
        them rules out half or more; the rest go by falling bound until the floor
        is above it, or together if they are most of the cell still.
        """
        qd, square = distances(self.pivots, q[None])[:, 0], float((q * q).sum())
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def bounds(far, squares):
            sure = np.maximum(far * (1 - 1e-9) - 1e-3, 0)  # room for rounding, so that a bound is never too low
            return (square + squares - sure * sure) / 2 + 1

        def evaluate(some):
            nonlocal best, score, floor
            best, score = np.concatenate([best, some]), np.concatenate([score, self.scores(some, q)])
            if len(score) > k:
                high = score >= np.partition(score, len(score) - k)[len(score) - k]
                best, score = best[high], score[high]
            top = np.lexsort((self.ids[best], -score))[:k]
            best, score = best[top], score[top]
            if len(best) == k:
                floor = max(floor, score[-1])

        far = np.abs(self.far[0] - qd[0])
        for p in range(1, min(PIVOTS_AT_ONCE, len(qd))):
            np.maximum(far, np.abs(self.far[p] - qd[p]), out=far)
        bound = bounds(far, self.squares)
        bound[self.ids == own] = -np.inf
        at = np.flatnonzero(bound >= max(floor, np.finfo(float).min))
        if len(at) > step:
            part = at[np.argpartition(-bound[at], step)]
            evaluate(part[:step])
            at = part[step:][bound[part[step:]] >= floor]
            for first in range(PIVOTS_AT_ONCE, len(qd), PIVOTS_AT_ONCE):
                before, closer = len(at), far[at]
                if before <= step:
                    break
                for p in range(first, min(first + PIVOTS_AT_ONCE, len(qd))):
                    np.maximum(closer, np.abs(self.far[p][at] - qd[p]), out=closer)
                far[at] = closer
                bound[at] = bounds(closer, self.squares[at])
                at = at[bound[at] >= floor]
                if len(at) > before / 2:
                    break
        if 2 * len(at) > len(self.ids):
            evaluate(at)
            return best, score
        at = at[np.argsort(-bound[at], kind="stable")]
        while len(at):
            evaluate(at[:step][bound[at[:step]] >= floor])
            at, step = at[step:], min(2 * step, 8192)
            if len(at) and bound[at[0]] < floor:
                break
        return best, score


ROWS = ("cell", "query", "vec_id", "v", "floor")
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search_cells(pivots: np.ndarray, width: int, k: int):
    """Rows by cell, vectors before queries -> the k best vectors of the cell for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, parts, cell = None, [], [], None
        for batch in (s for b in batches for s in slices(b, 1024)):
            number, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            vec, x, floor, out = batch.column(2).to_numpy(), matrix(batch.column(3), width), batch.column(4).to_numpy(zero_copy_only=False), []
            edges = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (query[1:] != query[:-1])))
            for a, b in zip(edges, np.append(edges[1:], len(number)), strict=True):
                if number[a] != last:
                    last, ids, parts, cell = number[a], [], [], None
                if not query[a]:
                    ids.append(vec[a:b])
                    parts.append(x[a:b])
                    continue
                if cell is None:
                    cell = Cell(np.concatenate(ids), np.concatenate(parts), pivots) if ids else None
                    ids, parts = [], []
                for i in range(a, b) if cell else ():
                    best, score = cell.search(vec[i], x[i], k, -np.inf if np.isnan(floor[i]) else floor[i])
                    out.append((np.full(len(best), vec[i]), cell.ids[best], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=FOUND)

    return run


def exact_topk(embeddings: DataFrame, query_filter: str = "vec_id % 100 = 0", k: int = 10, n_pivots: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best-scoring other vectors of every row that query_filter selects.

    Ties go to the smaller vec_id; fewer rows if there are fewer candidates.
    Repeated vec_ids stay rows of their own as candidates; several vectors of one
    query_id are one query, with the k best of all their scores. Vectors that
    are null or have null or non-finite components take no part; shorter ones
    count as followed by zeros; other columns are ignored; an empty table gives
    no rows. Pivots come from a bounded sample, so they travel with the code.
    Components should stay below 2**20 in size after scaling, so that bounds keep
    their precision.
    """
    spark = embeddings.sparkSession
    ship(spark)
    vectors = cut(whole_vectors(embeddings).withColumn("query", F.expr(query_filter)), "vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not width:  # no vectors, or empty ones alone
        width = 1
        if vectors.isEmpty():
            return none
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toArrow()["v"].combine_chunks()
    pivots = spread_pivots(matrix(drawn, width), n_pivots)

    @F.pandas_udf("home int, near double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        d = distances(matrix(pa.array(v, pa.list_(pa.int64())), width), pivots)
        return pd.DataFrame({"home": d.argmin(1), "near": d.min(1)})

    placed = cut(vectors.withColumn("h", nearest("v")).select("vec_id", "v", "query", "h.home", "h.near"), "placed")
    square = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    homes = placed.groupBy("home").agg(F.count("*").alias("n"), F.min("near").alias("low"), F.max("near").alias("high"), F.max(square).alias("square")).orderBy("home").toPandas()  # a row per pivot at most
    start, many = number_cells(homes["n"].tolist())
    spot = F.create_map(*[F.lit(int(x)) for h, a in zip(homes["home"], start, strict=True) for x in (h, a)])
    split = F.create_map(*[F.lit(int(x)) for h, n in zip(homes["home"], many, strict=True) for x in (h, n)])
    placed = placed.withColumn("cell", (spot[F.col("home")] + F.pmod(F.xxhash64("vec_id"), split[F.col("home")])).cast("int"))
    dealt = placed.select("cell", F.lit(False).alias("query"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    queries = placed.where("query").dropDuplicates(["vec_id", "v"])

    def search(asked: DataFrame, cells: DataFrame) -> DataFrame:
        rows = cells.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "query").select(*ROWS)
        return rows.mapInArrow(search_cells(pivots, width, k), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    own = queries.select("cell", F.lit(True).alias("query"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
    first = cut(search(own, dealt.join(own.select("cell").distinct(), "cell", "left_semi")), "first")
    floors = top(first).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    center = np.stack([pivots[h] for h in homes["home"]])
    low, high, squares = (homes[c].to_numpy() for c in ("low", "high", "square"))

    @F.pandas_udf("array<int>")
    def cells_left(v: pd.Series, floor: pd.Series, done: pd.Series) -> pd.Series:
        q = matrix(pa.array(v, pa.list_(pa.int64())), width)
        d = distances(q, center)
        far = np.maximum(np.maximum(low - d, d - high) * (1 - 1e-9) - 1e-3, 0)
        bound = ((q * q).sum(1)[:, None] + squares - far * far) / 2 + 1
        hit = bound >= np.where(np.isnan(floor), -np.inf, floor)[:, None]
        spread = [np.unique(np.concatenate([np.zeros(0, int), *(np.arange(start[h], start[h] + many[h]) for h in np.flatnonzero(own))])) for own in hit]
        return pd.Series([x[x != c] for x, c in zip(spread, done, strict=True)])

    left = queries.join(floors, "vec_id", "left").select(F.explode(cells_left("v", "floor", "cell")).alias("cell"), F.lit(True).alias("query"), "vec_id", "v", "floor")
    return top(first.unionByName(search(left, dealt))).select("query_id", "rank", "vec_id", "score")
