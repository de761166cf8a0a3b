"""Conversation repair against a search over suffixes that shares no code with the parser."""

import functools
import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratawave.llm import role_repair as rr

SCHEMA = "conv_id long, turn long, role string, text string"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """rows: (initial, must go, truncated) -> least (cost, audit)."""
    n = len(rows)

    @functools.cache
    def best(i, last, inserted=0):
        options = [(0, "")] if i == n and last in ("", "a") else []
        if inserted < 2:
            for x in "ua":
                if (last, x) in AFTER:
                    c, a = best(i, x, inserted + 1)
                    options.append((c + 2, "I" + a))
        if i < n:
            initial, must, truncated = rows[i]
            c, a = best(i + 1, last)
            options.append((c + 3, "D" + a))
            for x in "" if must else "sua":
                if (last, x) in AFTER:
                    c, a = best(i + 1, x)
                    if x == initial:
                        options.append((c + truncated, "K" + a))
                    if x != "s":
                        options.append((c + 2 + truncated, "R" + a))
        return min(options, default=(10**6, ""))

    for i in range(n, -1, -50):  # from the end, so that recursion stays shallow
        for last in ("", "s", "u", "a"):
            best(i, last)
    return best(0, "")


ROW = st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from([False, False, False, True]), st.booleans())
PARSER = rr.Grammar(rr.GRAMMAR)


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=12))
def test_the_parser_finds_the_cheapest_least_audit(rows):
    chart = rr.Repairer(PARSER)
    for row in rows:
        chart.feed(*row)
    cost, audit, roles = chart.finish()
    assert (cost, audit) == cheapest(rows)
    assert len(roles) == len(audit) - audit.count("D")
    body = roles[1:] if roles[:1] == "s" else roles
    assert body == "ua" * (len(body) // 2) and (not roles or body)


def test_a_long_conversation_keeps_its_open_edits_short(monkeypatch):
    monkeypatch.setattr(rr, "FLUSH", 16)
    rng = random.Random(5)
    rows = [(rng.choice("uuaasx"), rng.random() < 0.1, rng.random() < 0.3) for _ in range(400)]
    chart = rr.Repairer(PARSER)
    for i, row in enumerate(rows):
        chart.feed(*row)
        assert len(chart.column) <= 5
        if i % 16 == 15:
            assert max(c[3] if c else 0 for _, c in chart.column.values()) < 40
    assert chart.finish()[:2] == cheapest(rows)


def test_grammars_that_are_not_left_linear_are_refused():
    with pytest.raises(ValueError):
        rr.Grammar({**rr.GRAMMAR, "rules": [("talk", ["u", "talk"]), ("talk", [])]})


def report(rows):
    """A conversation's (turn, role, text) rows after damage -> the columns of repair_report, by plain loops."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.rstrip(rr.BLANKS)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
    left, out = iter(rows), []
    for e in audit:
        row = next(left) if e != "I" else (0, "", "")
        if e != "D":
            own = "user" if not out or out[-1][:1] in "sa" else "assistant"
            out.append(f"{row[1] if e == 'K' else own}:{row[2]}")
    return gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        own = out.setdefault(conv, [])
        h = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
            own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def test_reports_match_plain_loops(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n\t", None, "ends. \n", "é…", "a. ", "long " * 5000]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 4, 5, 9, -2]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in range(200) for _ in range(rng.randrange(1, 9))]
    rows += rng.choices(rows, k=80) + [(None, 1, "user", "x")] + [(c, 0, "user", "One.") for c in range(1000, 1100)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as audit", "2 as seq", "turn as cost")
    got = {r[0]: tuple(r)[1:] for r in rr.repair_report(table, rr.damaged(table)).collect()}
    want = {c: report(own) for c, own in damage(rows).items()}
    assert got == want
    assert any(not own for own in damage(rows).values())  # conversations that lose every row are among them


def test_repaired_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Well?"), (2, 0, "assistant", "Hello."), (3, 0, "user", " ")]
    turns = rr.with_faults(spark.createDataFrame(rows, SCHEMA))
    fixed = rr.apply_repairs(turns, rr.find_repairs(turns)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in fixed] == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Well?", "R"), (2, 0, "user", "", "I"), (2, 1, "assistant", "Hello.", "K")]
    empty = spark.createDataFrame([], SCHEMA)
    assert rr.repair_report(empty, rr.damaged(empty)).count() == 0
