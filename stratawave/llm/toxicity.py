"""Toxicity: a factorization machine over hashed terms, trained on a bounded labelled sample, scoring every text.

A text's features are distinct words, hashed; the machine adds linear weights and
pairwise interactions of factors, so that two words can weigh more together
than apart. A word becomes a feature if it tells the classes apart by itself, or
if its meeting with another word does so better than either of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_rows, forget, ship, slices

#: Terms are hashed into so many slots.
SLOTS = 1 << 22
#: Labelled documents per class that fit the model, at most.
PER_CLASS = 4_000
#: A slot is a feature if this many sampled documents have it and its log-likelihood ratio with the label is this high.
MIN_DOCUMENTS, MIN_RATIO = 3, 10.83
#: The sampled documents' most frequent slots, so many, are counted in pairs; both slots of a pair are
#: features if its ratio is this much higher than that of either.
PAIR_SLOTS, MIN_PAIR_RATIO = 512, 30.0
#: Words of which the feature is remembered, at most, before the memory is emptied.
MEMO = 400_000
WORD = re.compile(r"[^\W\d_]+")


def slot(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode()) % SLOTS


def words(text: str) -> set[str]:
    """Distinct runs of letters, in lower case."""
    return set(WORD.findall(text.lower()))


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w[i] x[i] + 1/2 sum_f ((sum v[i,f] x[i])^2 - sum (v[i,f] x[i])^2)), x[i] = presence of term i."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    features: dict[int, int]

    def __post_init__(self):
        self.memo: dict[str, int] = {}

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all texts in a row (each once per text), and how many each text has."""
        memo, rows = self.memo, []
        for text in texts:
            own = set()
            for w in words(text):
                f = memo.get(w)
                if f is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    f = memo[w] = self.features.get(slot(w), -1)
                own.add(f)
            own.discard(-1)
            rows.append(sorted(own))
        return np.array([f for r in rows for f in r], np.int64), np.array([len(r) for r in rows], np.int64)

    @staticmethod
    def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of consecutive groups, empty ones zero."""
        total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def margins(self, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        v = self.factors[slots]
        both = self.sums(v, sizes) ** 2 - self.sums(v * v, sizes)
        return self.bias + self.sums(self.linear[slots], sizes) + 0.5 * both.sum(1)

    def scores(self, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(slots, sizes), -30, 30)))


def log_likelihood_ratio(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> np.ndarray:
    """2 * (log likelihood with own rates - with one rate) of a of n_a and b of n_b documents having a term."""
    def part(k, n, rate):
        rate = np.clip(rate, 1e-12, 1 - 1e-12)
        return k * np.log(rate) + (n - k) * np.log1p(-rate)

    both = (a + b) / max(n_a + n_b, 1)
    return 2 * (part(a, n_a, a / max(n_a, 1)) + part(b, n_b, b / max(n_b, 1)) - part(a, n_a, both) - part(b, n_b, both))


def telling_pairs(slots: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (slot, slot, log odds beyond those of both) of frequent slots whose meeting tells the classes apart better than either slot does."""
    known, place, n_docs = *np.unique(slots, return_inverse=True), np.bincount(slots)
    top = np.lexsort((known, -n_docs[known]))[:PAIR_SLOTS]
    column = np.full(len(known), -1)
    column[top] = np.arange(len(top))
    row, col = np.repeat(np.arange(len(sizes)), sizes), column[place]
    x = np.zeros((len(sizes), len(top)), np.float32)
    x[row[col >= 0], col[col >= 0]] = 1
    toxic, clean = labels.sum(), len(labels) - labels.sum()
    a, b = (x * labels[:, None].astype(np.float32)).T @ x, (x * (1 - labels[:, None]).astype(np.float32)).T @ x
    a, b = a.astype(float), b.astype(float)
    ratio = log_likelihood_ratio(a, b, toxic, clean)
    own = np.diag(ratio)
    i, j = np.nonzero(np.triu((a + b >= MIN_DOCUMENTS) & (ratio >= np.maximum(own[:, None], own) + MIN_PAIR_RATIO), 1))
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
    alone = np.diag(odds)
    return known[top[i]], known[top[j]], odds[i, j] - (alone[i] + alone[j]) / 2


def fit(slots: np.ndarray, sizes: np.ndarray, labels: np.ndarray, n_factors: int = 4, epochs: int = 15, rate: float = 0.05, decay: float = 1e-4, seed: int = 7, min_ratio: float = MIN_RATIO) -> FactorizationMachine:
    """Features by likelihood ratio of slots and pairs; linear weights start from smoothed log odds, factors of telling pairs from theirs; then mini-batch AdaGrad on the log loss of the whole machine."""
    rng, n = np.random.default_rng(seed), len(sizes)
    toxic, row = labels.sum(), np.repeat(np.arange(n), sizes)
    one, other, beyond = telling_pairs(slots, sizes, labels) if len(slots) else (slots, slots, slots)
    known, place = np.unique(slots, return_inverse=True)
    a = np.bincount(place, labels[row], len(known))
    b = np.bincount(place, 1 - labels[row], len(known))
    keep = (a + b >= MIN_DOCUMENTS) & (log_likelihood_ratio(a, b, toxic, n - toxic) >= min_ratio) | np.isin(known, np.append(one, other))
    feature = np.where(keep, np.cumsum(keep) - 1, -1)[place]
    sizes = np.bincount(row[feature >= 0], minlength=n)
    slots = feature[feature >= 0]
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (n - toxic + 1))
    size = int(keep.sum())
    m = FactorizationMachine(float(np.log((toxic + 1) / (n - toxic + 1))), odds[keep] / 2, rng.normal(0, 0.1, (size, n_factors)), dict(zip(known[keep].tolist(), range(size), strict=True)))
    for k, (i, j, w) in enumerate(zip(one.tolist(), other.tolist(), np.clip(beyond, -4, 4).tolist(), strict=True)):
        start = abs(w) ** 0.5
        m.factors[m.features[i], k % n_factors] += start
        m.factors[m.features[j], k % n_factors] += start if w > 0 else -start
    g_bias, g_linear, g_factors = 1e-8, np.full(size, 1e-8), np.full((size, n_factors), 1e-8)
    starts = np.cumsum(sizes) - sizes
    for _ in range(epochs if size else 0):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            rows = order[at : at + 128]
            own_sizes = sizes[rows]
            own = slots[np.repeat(starts[rows] - (np.cumsum(own_sizes) - own_sizes), own_sizes) + np.arange(own_sizes.sum())]
            inside = np.repeat(np.arange(len(rows)), own_sizes)
            v = m.factors[own]
            total = m.sums(v, own_sizes)
            error = m.scores(own, own_sizes) - labels[rows]
            e = error[inside] / len(rows)
            d_linear = np.bincount(own, e, size) + decay * m.linear
            inner = e[:, None] * (total[inside] - v)
            d_factors = np.stack([np.bincount(own, inner[:, f], size) for f in range(n_factors)], 1) + decay * m.factors
            d_bias = error.mean()
            g_linear += d_linear**2
            g_factors += d_factors**2
            g_bias += d_bias**2
            m.linear -= rate * d_linear / np.sqrt(g_linear)
            m.factors -= rate * d_factors / np.sqrt(g_factors)
            m.bias -= rate * d_bias / np.sqrt(g_bias)
    return m


def is_held_out() -> Column:
    """Column: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """text, toxic of at most per_class labelled documents of either class that are not held out, those of smallest hash."""
    usable = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~is_held_out())
    pick = lambda c: usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1))
    return doc_rows(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most 2 * per_class ids


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FactorizationMachine:
    """Fit on the bounded sample; only chosen slots of its terms, not texts, come to the driver. Without labels every score is the prior."""
    ship(docs.sparkSession)
    schema = pa.schema([("order", pa.int64()), ("slots", pa.list_(pa.int32())), ("toxic", pa.int32())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(t.encode()) >> 1 for t in texts], pa.int64()), pa.array([sorted({slot(w) for w in words(t)}) for t in texts], schema.field(1).type), batch.column(1).cast(pa.int32())], schema=schema)

    sample = cut(training_sample(docs, labels, per_class).mapInArrow(hashed, "order long, slots array<int>, toxic int"), "sample")
    n, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    chosen = sample.select("toxic", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("toxic").alias("a"), F.count("*").alias("both"))
    common = chosen.orderBy(F.desc("both"), "slot").limit(PAIR_SLOTS)
    chosen = common.unionByName(chosen.where((F.col("both") >= MIN_DOCUMENTS) & (_ratio(F.col("a"), F.col("both") - F.col("a"), toxic or 0, n - (toxic or 0)) >= 0.999 * MIN_RATIO))).select("slot").distinct()
    # Only what the choice leaves comes to the driver: documents of the bounded sample, with the few slots that tell the classes apart and the commonest ones.
    hits = sample.select("order", F.explode("slots").alias("slot")).join(chosen, "slot").groupBy("order").agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    rows = sample.select("order", "toxic").join(hits, "order", "left").select("order", F.coalesce("slots", F.array().cast("array<int>")).alias("slots"), "toxic").toArrow().sort_by([("order", "ascending"), ("toxic", "ascending")])
    forget(sample)
    sizes = rows["slots"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
    flat = rows["slots"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
    return fit(flat.astype(np.int64), sizes.astype(np.int64), rows["toxic"].to_numpy().astype(float))


def _ratio(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """log_likelihood_ratio over columns."""
    def part(k, n, rate):
        rate = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), rate))
        return k * F.ln(rate) + (n - k) * F.log1p(-rate)

    both = (a + b) / max(n_a + n_b, 1)
    return 2 * (part(a, F.lit(n_a), a / max(n_a, 1)) + part(b, F.lit(n_b), b / max(n_b, 1)) - part(a, F.lit(n_a), both) - part(b, F.lit(n_b), both))


def score_texts(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1). Null texts are empty; rows without doc_id are left out."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # grows with the bounded sample alone
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (s for b in batches for s in slices(b, 256)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(*m.batch(batch.column(1).to_pylist())))], schema=schema)

    return doc_rows(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 if score >= threshold).

    labels, of which several for one document count as toxic if one does, serve
    training alone; lang, source and other columns are ignored. Null texts are
    empty, and empty texts score by the model's bias; repeated rows are returned
    each, with one score; rows without doc_id are left out; an empty table gives
    no rows.
    """
    return score_texts(docs, train(docs, labels, per_class)).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold, repeated ones each; rows without doc_id go; null texts count as empty."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, per_class))

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (s for b in batches for s in slices(b, 256)):
            texts = ["" if t is None else t for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(m.scores(*m.batch(texts)) < threshold))

    return docs.where("doc_id is not null").mapInArrow(run, docs.schema)
