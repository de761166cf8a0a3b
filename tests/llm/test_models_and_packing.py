import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratawave.llm import packing, queries, topk_search, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
PATH = P.path("word_bpe_49k.json")


def check_packed(rows, ids_of, max_len=2048):
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens == len(ids_of[r.doc_id])
    for doc, ids in ids_of.items():
        at = 0
        for start, length, crc in sorted(pieces[doc]):
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= max_len
    assert sorted(seqs) == list(range(len(seqs)))
    return seqs


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)  # as the contract words it: the file, and add_special_tokens=False when encoding


def test_packing_query(spark):
    lib = library()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    rows = queries.op6_packing(spark, SF).collect()
    seqs = check_packed(rows, ids)
    assert len(seqs) <= 1.01 * sum(map(len, ids.values())) / 2048 + 1


def test_packing_ids_are_the_librarys():
    t, lib, rng = packing.WordTokenizer(PATH), library(), random.Random(7)
    pool = ["İ", "ǅ", "ß", "Σ", "ς", "ŉ", "é", "e\u0301", "\u0301", "'s", "'S", "’s", "1", "٣", "中", "“", "!", ".", "...", ",", "ing", "A", "b", " ", "  ", "\u2028", "\u0085", "\u00a0", "\u200b", "\u3000", "\x1c", "K", "Å", "😀", "İ.", "LI!", "&&&", "<|endoftext|>", "</w>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(6000)] + ["中 İ...", "“ALİ! VELİ...", *(f"ab{chr(c)}cd" for c in range(0x3100) if not 0xD800 <= c < 0xE000)]
    for parts, new in ((packing.WordTokenizer.PARTS, 1.0), (50, 1.0), (50, 0.0)):  # roomy, full, and always starting anew
        t.PARTS, t.NEW = parts, new
        t.clear()
        for a in range(0, len(texts), 700):
            for x, ids in zip(texts[a : a + 700], t.encode_batch(texts[a : a + 700]), strict=True):
                assert ids.tolist() == lib.encode(x, add_special_tokens=False).ids, x


def test_special_tokens_in_texts_are_the_librarys():
    t, lib = packing.WordTokenizer(PATH), library()
    texts = ["<|endoftext|> b", "a<|endoftext|>b c", "<|ENDOFTEXT|> b", "x <|startoftext|><|endoftext|>", "<|endoftext", "|> <| endoftext |>"]
    assert [x.tolist() for x in t.encode_batch(texts)] == [lib.encode(x, add_special_tokens=False).ids for x in texts]
    assert t.encode_batch(["<|endoftext|> b"])[0].tolist() == [49407, 321]


def test_packing_edges(spark):
    rng = random.Random(2)
    texts = [None, "", "Hello  wORLD's\x1c\n\nfoo123 é", "<|endoftext|> x", "a b " * 9000, *("".join(rng.choice(["A", "é", " ", "é", "ß", "Σ", "'s", "1", " ", "İ", "ing"]) for _ in range(40)) for _ in range(200))]
    docs = spark.createDataFrame([*((i, t, 0) for i, t in enumerate(texts)), (None, "gone", 0)], "doc_id long, text string, length int")
    lib = library()
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    placed = packing.pack_documents(docs, PATH, 64)
    check_packed(placed.collect(), ids, 64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs, placed, PATH, 64).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]
    assert all(len(v) == 64 or len(v) & (len(v) - 1) == 0 for v in whole.values())
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    twice = packing.pack_documents(docs.where("doc_id = 2").union(docs.where("doc_id = 2")), PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == 2


def test_histogram_places_everything():
    rng = random.Random(1)
    counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(60)}
    filled, ranks = {}, {n: set() for n in counts}
    for length, rank, first, many, offset in packing.pack_histogram(counts, 100):
        for j in range(many):
            assert filled.get(first + j, 0) == offset
            filled[first + j] = offset + length
            ranks[length].add(rank + j)
    assert max(filled.values()) <= 100 and all(ranks[n] == set(range(c)) for n, c in counts.items())


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CELL_VECTORS", 40)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)], i) for i in range(0, 1200, 3)]
    rows += [(5000, None, 1), (5100, [float("nan")] * 8, 1), (5200, [None] * 8, 1), (5300, [float("inf")] * 8, 1), (None, [0.1] * 8, 1), (5400, [], 1), (5500, [0.5, 0.5], 1)]
    rows += [(6000 + i, rows[7][1], 0) for i in range(30)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk_search.exact_topk(emb).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    wide = {i: np.pad(v, (0, 8 - len(v))) for i, v in whole.items()}
    for q in (i for i in wide if i % 100 == 0):
        best = sorted(((-int(wide[q] @ v), i) for i, v in wide.items() if i != q))[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    assert sorted(got) == sorted(i for i in wide if i % 100 == 0)
    assert topk_search.exact_topk(emb.limit(0)).count() == 0
    assert topk_search.exact_topk(emb.where("vec_id = 300")).count() == 0


def test_topk_cells(monkeypatch):
    monkeypatch.setattr(topk_search, "CELL_VECTORS", 10)
    assert topk_search.number_cells([3, 7, 1, 25, 4, 10, 10]) == ([0, 0, 1, 2, 5, 6, 7], [1, 1, 1, 3, 1, 1, 1])


def test_topk_eliminates_by_pivots():
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 1, (40, 16))
    x = np.floor(1024 * (centers[np.arange(4000) % 40] + rng.normal(0, 0.05, (4000, 16)))).astype(np.int64)
    pivots = topk_search.spread_pivots(x[:1000], 64)
    assert len(np.unique(pivots, axis=0)) == 64
    cell = topk_search.Cell(np.arange(4000)[::-1].copy(), x[::-1].copy(), pivots)
    for own in range(0, 4000, 100):
        score = x @ x[own]
        score[own] = -(1 << 62)
        want = np.lexsort((np.arange(4000), -score))[:10]
        best, got = cell.search(own, x[own], 10, -np.inf, step=64)
        assert cell.ids[best].tolist() == want.tolist() and got.tolist() == score[want].tolist()
        again, _ = cell.search(own, x[own], 10, float(score[want[-1]]), step=64)  # with the floor of an earlier pass
        assert again.tolist() == best.tolist()
    assert cell.evaluated < 0.25 * 2 * 40 * 4000, cell.evaluated


def test_toxicity_learns_an_interaction():
    rng = np.random.default_rng(1)
    base = [rng.choice(np.arange(100, 2000), 12, replace=False) for _ in range(1200)]
    rows, labels = [], []
    for i, own in enumerate(base):  # slots 1 and 2 are toxic together only
        own = np.unique(np.append(own, [[], [1], [2], [1, 2]][i % 4])).astype(np.int64)
        rows.append(own)
        labels.append(float(i % 4 == 3))
    m = toxicity.fit(np.concatenate(rows), np.array(list(map(len, rows))), np.array(labels), epochs=60, min_ratio=0)
    kept = [[m.features[x] for x in own if x in m.features] for own in rows]
    s = m.scores(np.array([f for own in kept for f in own], np.int64), np.array(list(map(len, kept))))
    y = np.array(labels)
    assert ((s >= 0.5) == (y == 1)).mean() > 0.97


def pair_sum(model, features):
    """The machine's margin, pair by pair."""
    pairs = sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(features) for j in features[:k])
    return model.bias + sum(float(model.linear[i]) for i in features) + pairs


def test_margins_are_sums_over_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.FactorizationMachine(-0.3, rng.normal(0, 1, 30), rng.normal(0, 0.5, (30, 4)), {})
    rows = [sorted(rng.choice(30, n, replace=False).tolist()) for n in (0, 1, 2, 7, 30, 0)]
    got = m.margins(np.array([f for r in rows for f in r], np.int64), np.array(list(map(len, rows))))
    assert got == pytest.approx([pair_sum(m, r) for r in rows])


@pytest.mark.parametrize("kind", ["both", "equal"])
def test_words_that_matter_only_together(spark, kind):
    """Production settings: an insult and a group word, alike frequent in clean and toxic texts; toxic is where both meet (or, equal, where both or neither stand)."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(9000):
        insult, group = rng.random(2) < 0.3
        toxic = insult == group
        if kind == "both":
            toxic = rng.random() < 0.15
            u = rng.random()
            insult, group = (u < 0.3, u < 0.3) if toxic else (u < 0.3, 0.3 <= u < 0.6)
        other = [f"w{'abcdefghij'[k // 1000]}{'abcdefghij'[k // 100 % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}" for k in rng.choice(3000, 25, replace=False)]
        text = other + ["insult"] * bool(insult) + ["group"] * bool(group)
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(toxic), bool(insult), bool(group)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, insult boolean, group boolean")
    got = toxicity.toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic")).where("held_out").join(table, "doc_id")
    both, caught, one, wrong, none, right = got.selectExpr("count_if(insult and group)", "count_if(insult and group and predicted = 1)", "count_if(insult <> group)", "count_if(insult <> group and predicted = 1)", "count_if(not insult and not group)", f"count_if(not insult and not group and predicted = {int(kind == 'equal')})").first()
    assert both > 80 and caught >= 0.9 * both and wrong <= 0.01 * one and right >= 0.99 * none


def test_toxicity_query_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.toxic is not None}
    assert max(sum(labels.values()), len(labels)) <= toxicity.PER_CLASS  # so every usable label is in the sample
    own = sorted((xxhash.xxh64_intdigest(docs[i].encode()) >> 1, y, i) for i, y in labels.items() if i in docs)
    slots = [sorted({toxicity.slot(w) for w in toxicity.words(docs[i])}) for _, _, i in own]
    y = np.array([float(t) for _, t, _ in own])
    m = toxicity.fit(np.array([x for r in slots for x in r], np.int64), np.array(list(map(len, slots))), y)
    for r in queries.op10_toxicity(spark, SF).collect():
        features = sorted({m.features[toxicity.slot(w)] for w in toxicity.words(docs[r.doc_id]) if toxicity.slot(w) in m.features})
        score = 1 / (1 + np.exp(-np.clip(pair_sum(m, features), -30, 30)))
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == (r.score >= 0.7), r.doc_id


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, d)
    assert got.where("score < 0 or score > 1 or predicted <> case when score >= 0.7 then 1 else 0 end").count() == 0
    r = got.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n, clean, caught, false = r.selectExpr("count_if(toxic = 1)", "count_if(toxic = 0)", "count_if(toxic = 1 and predicted = 1)", "count_if(toxic = 0 and predicted = 1)").first()
    assert caught >= 0.8 * n and false <= 0.01 * clean, (n, clean, caught, false)  # over all held-out labels


def test_toxicity_edges(spark):
    rows = [(i, t, 1) for i, t in enumerate([None, "", "x " * 200_000, "you idiot", "fine words"])]
    docs = spark.createDataFrame([*rows, rows[3], (None, "gone", 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 3, 4] and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(3, 1), (3, None), (4, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert [r.held_out for r in sorted(got)] == [zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in sorted(got)]
