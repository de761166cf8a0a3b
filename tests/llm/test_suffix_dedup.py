import hashlib
import random

import numpy as np

from stratawave.llm import queries, suffix_dedup


def brute(rows, length=50):
    """doc_id -> (bytes, removed, spans, digest), by the smallest doc_id of every string."""
    least = {}
    for d, t in sorted(rows):
        for i in range(len(t) - length + 1):
            least.setdefault(t[i : i + length], d)
    out = {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def compare(got, want):
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(300):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 200)))
        depth = rng.choice([3, 9, 20, 50])
        s = np.concatenate([np.frombuffer(text, np.uint8).astype(np.int64) + 1, np.zeros(depth + 3, np.int64)])
        order = suffix_dedup.suffix_order(s, len(text), depth)
        assert sorted(order) == list(range(len(text)))
        prefixes = [text[i : i + depth] for i in order]
        assert prefixes == sorted(prefixes)


def test_winnowing_is_local():
    rng = random.Random(2)
    shared = bytes(rng.choice(b"abcdef ") for _ in range(60))
    a = np.frombuffer(b"x" * 30 + shared + b"y" * 40, np.uint8)
    b = np.frombuffer(b"zq" * 50 + shared, np.uint8)
    (f_a, h_a), (f_b, _) = suffix_dedup.fingerprints(a), suffix_dedup.fingerprints(b)
    for k in range(11):
        assert f_a[30 + k] == f_b[100 + k] == h_a[30 + k : 30 + k + suffix_dedup.WINDOW].min()


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(r > 0 for _, r, _, _ in want.values()) > 10
    compare(queries.op3_suffix_dedup(spark, d).collect(), want)


def test_overlaps_hot_strings_and_edges(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    passage = word(130)
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 51, "a" * 300, "ab" * 100, "ba" * 100 + "c", word(50_000)]
    texts += [word(rng.randrange(5, 80)) + passage[rng.randrange(10) :] + word(rng.randrange(5, 80)) for _ in range(120)]
    texts += [texts[20], texts[20], texts[9][1000:3000] + "!" + texts[9][5000:5049], texts[9]]
    ids = [i if i % 7 else i - (5 << 40) * (i % 14 == 7) + (1 << 33) for i in range(len(texts))]
    ids[0] = 0
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame([*((i, t, 1) for i, t in rows), (None, passage, 1)], "doc_id long, text string, fps int").repartition(5)
    want = brute([(i, (t or "").encode()) for i, t in rows])
    for hot, size in ((64, 16 << 20), (2, 2000)):
        monkeypatch.setattr(suffix_dedup, "HOT_GROUPS", hot)
        monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", size)
        compare(queries.removed_digests(suffix_dedup.repeated_spans(docs)).collect(), want)
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0
    again = suffix_dedup.repeated_spans(docs.where("doc_id = 0").union(docs.where("doc_id = 0"))).collect()
    assert len(again) == 2 and not any(r.spans for r in again)


def test_a_hot_string_is_dealt_alike_for_texts_sent_and_not_sent(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(120)
    # The smallest holder fills a group of its own; the others come in groups of two, of which one is sent.
    texts = [word(300) + passage + word(100), *(word(40) + passage + word(60) for _ in range(160))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = brute([(i, t.encode()) for i, t in enumerate(texts)])
    assert all(removed >= 120 for d, (_, removed, _, _) in want.items() if d)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 400)
    for hot in (64, 2):
        monkeypatch.setattr(suffix_dedup, "HOT_GROUPS", hot)
        compare(queries.removed_digests(suffix_dedup.repeated_spans(docs)).collect(), want)


def test_documents_that_share_a_doc_id_keep_apart(spark, monkeypatch):
    """Several texts of one doc_id: each loses only what smaller doc_ids hold, and none loses another one's places."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    x, y = word(280), word(90)
    rows = [(1, x), (5, word(70) + x), (5, word(700)), (5, x), (6, y), (6, word(33) + y + word(20)), (6, y + word(60)), (7, y + word(5)), (7, word(400)), (7, word(400)), (-3, word(20) + y), (-3, word(90))]
    rows += [(20 + i % 9, word(rng.randrange(60)) + rng.choice([x, y, ""]) + word(rng.randrange(400))) for i in range(60)]
    rows += [rows[1], rows[-1]]
    want = sorted((d, *brute_row(t.encode(), d, rows)) for d, t in rows)
    for hot, size in ((64, 16 << 20), (2, 2000)):
        monkeypatch.setattr(suffix_dedup, "HOT_GROUPS", hot)
        monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", size)
        got = queries.removed_digests(suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def brute_row(text, doc_id, rows):
    """(bytes, removed, spans, digest) of one text beside all others, itself included."""
    smaller = [(d, t.encode()) for d, t in rows if d < doc_id]
    return brute([*smaller, (doc_id, text)])[doc_id]


def test_a_document_of_repeated_starts_alone_is_sent_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 3000)
    seen = []
    real = suffix_dedup.context_rows
    monkeypatch.setattr(suffix_dedup, "context_rows", lambda buf, at, length: seen.append(len(at)) or real(buf, at, length))
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    rows = [(1, text), (2, "!" + text), (3, text[2000:])]
    batches = []
    f, _ = suffix_dedup.fingerprints(np.frombuffer(text.encode(), np.uint8))
    fps = np.unique(f).astype("<u8").tobytes()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text]), pa.array([[fps]]), pa.array([[bytes([1]) * (len(fps) // 8)]])], ["number", "text", "fps", "hot"])
    batches = list(suffix_dedup.send_contexts(4, 3000, 0)(iter([batch])))
    assert len(batches) > 50 and max(seen) <= 20  # 150 bytes a context
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(queries.removed_digests(suffix_dedup.repeated_spans(docs)).collect(), brute([(d, t.encode()) for d, t in rows]))
