"""Alignment against loops over whole texts encoded by the libraries as they come."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratawave.llm import token_align as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def whole():
    """text -> (A ids, A byte lengths, B ids, B byte lengths), empty where bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = ta.byte_letters()
    names = {i: t for t, i in a.get_vocab(True).items()}

    def run(text):
        ids, others = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        own = [bytes(letters[c] for c in names[i]) for i in ids]
        pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in others]
        raw = (" " + text).encode()
        good = text and b"".join(own) == raw == b"".join(pieces)
        return (ids, [*map(len, own)], others, [*map(len, pieces)]) if good else ([], [], [], [])

    return run


def loops(a, a_lengths, b, b_lengths):
    """Groups as text and links of one text."""
    ends = [np.cumsum(x).tolist() for x in (a_lengths, b_lengths)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, found, last = [], [], 0
    for c in cuts:
        own, other = ([i for i, e in enumerate(s) if last < e <= c] for s in ends)
        groups.append(",".join(str(a[i]) for i in own) + "|" + ",".join(str(b[j]) for j in other))
        for i in own:
            for j in other:
                if ends[0][i] - a_lengths[i] < ends[1][j] and ends[1][j] - b_lengths[j] < ends[0][i]:
                    found.append((a[i], b[j]))
        last = c
    return groups, found


def brute(rows, whole):
    docs = [(i, *loops(*(e := whole(t or ""))), len(e[0]), len(e[2])) for i, t in rows if i is not None]
    counts = Counter(p for _, _, found, _, _ in docs for p in set(found))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted((i, na, nb, len(g), len(f), sum(counts[p] == best[p[0]] for p in f), sum(counts[p] for p in f), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, g, f, na, nb in docs)


def test_the_files_allow_cuts_inside_texts():
    assert ta.cuts_are_safe(A, B)


ALPHABET = st.one_of(st.sampled_from(list(" \n\t.,'-!?\"()$#0123abcdeXYZéüñß×÷ ​　…—▁💡中文<|>") + ["'s", "don't", "<|endoftext|>", "</s>", "  ", "\r\n", "\x00", "\x85", "\x1c", "ing", "the "]), st.characters(codec="utf-8"))


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=40))
def test_parts_encode_as_the_whole_text(whole, letters):
    text = "".join(letters)
    raw = np.frombuffer((" " + text).encode(), np.uint8)
    at = [0, *ta.boundaries(raw).tolist(), len(raw)]
    parts = [raw[x:y].tobytes().decode() for x, y in zip(at, at[1:])]
    got = list(ta.loaded(A, B).encode(parts)) if text else []
    if text and all(g[0] for g in got):
        assert tuple([x for g in got for x in g[k]] for k in range(4)) == whole(text)
    else:
        assert whole(text) == ([], [], [], [])


TEXTS = [
    "", None, "a", " ", "   two  spaces ", "The cat's hat isn't 1234567 long.\n\nNext-line; naïve café — résumé!", "<|endoftext|> and </s> are text", "▁ is no space", "tab\tand\x00nul", "中文字符没有空格" * 30, "💡" * 200, "word " * 3000,
    "x" * 20_000, "supercalifragilistic-expialidocious.,;:!?$#", "end ", "same words same words", "same words same words", "Ünïcödé ÄÖÜß ñandú",
]


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_documents_match_loops(spark, whole, size):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (5, "another text of five"), (None, "left out")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as part", "3 as end")
    assert result(ta.align_documents(docs, A, B, block_bytes=size)) == brute(rows, whole)


def test_whole_texts_without_cuts(spark, whole, monkeypatch):
    monkeypatch.setattr(ta, "cuts_are_safe", lambda *_: False)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    assert result(ta.align_documents(spark.createDataFrame(rows, SCHEMA), A, B)) == brute(rows, whole)


def test_the_table(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(ta.align_documents(docs, A, B, block_bytes=100_000)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], whole)


def test_empty_tables(spark):
    assert ta.align_documents(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    none = result(ta.align_documents(spark.createDataFrame([(1, None), (2, "")], SCHEMA), A, B))
    assert none == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
