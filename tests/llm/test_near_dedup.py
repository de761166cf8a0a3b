import random
import re

from stratawave.llm import near_dedup, queries


def word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """doc_id -> (set size, smallest doc_id linked), over all pairs that share a shingle."""
    sets = {i: word_shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {}
    for own in by.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), both in pairs.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def compare(got, want):
    got = {r.doc_id: r for r in got}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(i != c for i, (_, c) in want.items()) > 50
    compare(queries.op1_near_dedup(spark, d).collect(), want)


def test_chains_passages_and_edges(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(60)]
    base = [word() for _ in range(100)]
    for i in range(70):  # copies near the base, but less near each other
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(100)] = word()
        rows.append(" ".join(own))
    for i in range(60):  # a passage that many share, not enough to link
        rows.append(" ".join([word() for _ in range(40)] + passage + [word() for _ in range(30)]))
    own = [word() for _ in range(120)]
    for i in range(40):  # a chain: neighbours are linked, its ends are not
        own = [*own[3:], *(word() for _ in range(3))]
        rows.append(" ".join(own))
    rows += ["Ab c", "aB\tc ", "ab c d e f", "AB C D E F g", "x", "É x", "é x", "", " \n", None, "z " * 60_000, "z\n" * 70_000]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    table = [(i, t, 1) for i, t in zip(ids, rows, strict=True)]
    docs = spark.createDataFrame([*table, (None, "gone", 1)], "doc_id long, text string, key int").repartition(3)
    want = brute([(i, t) for i, t, _ in table])
    compare(near_dedup.near_duplicates(docs).collect(), want)
    twice = docs.union(docs.limit(5))
    assert near_dedup.near_duplicates(twice).count() == len(rows) + docs.limit(5).where("doc_id is not null").count()
    kept = near_dedup.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c) and kept.columns == docs.columns
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_one_document_with_two_texts_links_both(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(3)]
    edit = lambda own, k: " ".join(own[:k] + [f"x{k}"] + own[k + 1 :])
    rows = [(9, " ".join(base[0])), (9, " ".join(base[1])), (4, edit(base[0], 0)), (7, edit(base[1], 79)), (7, edit(base[1], 79)), (8, " ".join(base[2]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(4, 4, True), (7, 4, False), (7, 4, False), (8, 8, True), (9, 4, False), (9, 4, False)]


def test_cells_keep_every_link_and_do_not_repeat_small_buckets(spark, monkeypatch):
    rows = [(k, d, 10, d if k % 2 else d % 3) for k in range(6) for d in range(12 + 8 * k)]
    members = spark.createDataFrame(rows, "key long, doc long, n int, comp long")
    for block in (1024, 5):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got, met = near_dedup.cells(members).collect(), set()
        for cell in {(r.key, r.i, r.j) for r in got}:
            own = [r for r in got if (r.key, r.i, r.j) == cell]
            met |= {(r.key, *sorted((r.doc, s.doc))) for r in own for s in own if r.comp != s.comp and (r.chunk != s.chunk or r.first and r.chunk == r.i)}
        assert met == {(a[0], *sorted((a[1], b[1]))) for a in rows for b in rows if a[0] == b[0] and a[3] != b[3]}
        assert len(got) == len(rows) or block == 5


def test_slices_follow_the_weight_of_texts(monkeypatch):
    import pyarrow as pa

    from stratawave.llm import common

    texts = ["a b c d e f " * 1000] * 30 + ["x", None, ""] * 400 + ["y " * 40_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(common.weighed(batch, 1, 256, 50_000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or (p.num_rows <= 256 and sum(len(t or "") for t in p.column(1).to_pylist()) <= 50_000) for p in parts)
    assert list(common.weighed(batch.slice(0, 0), 1)) == []
    seen = []
    real = near_dedup.shingle_sets
    monkeypatch.setattr(near_dedup, "shingle_sets", lambda t: seen.append(sum(map(len, t))) or real(t))
    heavy = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["a b c d e f " * 30_000] * 60)], ["doc_id", "text"])
    rows = [r for out in near_dedup.shingle_rows(iter([heavy])) for r in out.to_pylist()]
    assert len(rows) == 60 and max(seen) <= 4 << 20 and len(seen) > 4
