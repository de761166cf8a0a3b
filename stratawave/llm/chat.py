"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns stream through tasks by (conversation, turn). The machine emits text
segments (conversation, number, text, loss flag); control strings inside texts
are escaped reversibly, so the segments alone give the turns back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

#: Roles: what stands before and after a turn's text, and whether the text is under the loss mask.
#: order: state -> role -> next state; a turn without a transition is invalid and leaves the state unchanged.
TEMPLATE = {
    "begin": "<s>",
    "end": "<end>",
    "roles": {
        "system": {"open": "[SYS] ", "close": " [/SYS]", "loss": False},
        "user": {"open": "[INST] ", "close": " [/INST]", "loss": False},
        "assistant": {"open": "[ANS] ", "close": "</s>", "loss": True},
    },
    "other": {"open": "[ROLE ", "name_end": "] ", "close": " [/ROLE]", "loss": False},
    "order": {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    "final": ["answered"],
}


def control_strings(template: dict) -> list[str]:
    """Every mark of the template without surrounding blanks, longest first."""
    marks = {template["begin"], template["end"], template["other"]["open"], template["other"]["close"], template["other"]["name_end"]}
    for r in template["roles"].values():
        marks |= {r["open"], r["close"]}
    return sorted({m.strip() for m in marks}, key=lambda m: (-len(m), m))


def escaper(template: dict) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """escape, unescape: backslashes are doubled, and one is put after the first character of each control string."""
    marks = re.compile("|".join(re.escape(m) for m in control_strings(template)))

    def escape(text: str) -> str:
        text = text.replace("\\", "\\\\")
        return marks.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(text: str) -> str:
        return re.sub(r"\\(.?)", r"\1", text, flags=re.DOTALL) if "\\" in text else text

    return escape, unescape


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
SEGMENTS_DDL = "conv_id long, segment long, text string, loss boolean, valid boolean"


def emit_segments(template: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns (conv_id, turn, role, text) in order -> segments; state crosses batches, texts do not."""
    order, roles, other = template["order"], template["roles"], template["other"]
    escape, _ = escaper(template)

    def run(batches):
        conv, state, number, good = None, "start", 0, True

        def closing():
            return (conv, number, template["end"], False, good and state in template["final"])

        for batch in (s for b in batches for s in slices(b)):
            out = []
            for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if own != conv:
                    if conv is not None:
                        out.append(closing())
                    conv, state, number, good = own, "start", 0, True
                step = order[state].get(role)
                good, state = good and step is not None, step or state
                r = roles.get(role)
                head = r["open"] if r else other["open"] + escape(role) + other["name_end"]
                r = r or other
                for piece, loss in (((template["begin"] if not number else "") + head, False), (escape(text), r["loss"]), (r["close"], False)):
                    out.append((conv, number, piece, loss, good))
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SEGMENTS, strict=True)], schema=SEGMENTS)
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(closing(), SEGMENTS, strict=True)], schema=SEGMENTS)

    return run


def format_chats(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Segments of every conversation: conv_id, segment (from 0), text, loss, valid.

    Joined by segment number they are the formatted conversation. valid turns
    false at the first turn that the template's order does not allow, and at
    the closing segment if the conversation does not end in a final state.
    Turns go by turn (nulls first), ties by role and text; repeated rows stay.
    Null texts and roles are empty. Rows without conv_id are left out; other
    columns are ignored; an empty table gives no segments.
    """
    ship(conversations.sparkSession)
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(emit_segments(template), SEGMENTS_DDL)


def parse_stream(template: dict) -> Callable[[Iterator[tuple[str, bool]]], Iterator[tuple[str, str, bool]]]:
    """Formatted text as (text, loss) pieces -> (role, text, under loss) per turn, reading only the text's own marks."""
    roles, other = template["roles"], template["other"]
    _, unescape = escaper(template)
    opens = {r["open"]: name for name, r in roles.items()}
    first = re.compile("|".join(re.escape(o) for o in [*opens, other["open"]]))

    def run(pieces):
        rest, masked = "", []
        for text, loss in pieces:
            if loss:
                masked.append((len(rest), len(rest) + len(text)))
            rest += text
            while True:
                start = len(template["begin"]) if rest.startswith(template["begin"]) else 0
                m = first.match(rest, start)
                if not m:
                    break
                role, at = opens.get(m[0]), m.end()
                if role is None:
                    stop = rest.find(other["name_end"], at)
                    role, at = unescape(rest[at:stop]), stop + len(other["name_end"])
                close = roles.get(role, other)["close"]
                stop = rest.find(close, at)
                if stop < 0:
                    break
                yield role, unescape(rest[at:stop]), (at, stop) in masked
                rest, masked = rest[stop + len(close) :], []
        if rest not in (template["end"], ""):
            raise ValueError(f"not a formatted conversation: {rest[:80]!r}")

    return run


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
DIGESTS_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digest_segments(template: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments in order -> a row per conversation with digests of the turns that parsing gives back."""
    import itertools

    parse = parse_stream(template)

    def rows(batches):
        for batch in (s for b in batches for s in slices(b)):
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True)

    def run(batches):
        done = []
        for conv, own in itertools.groupby(rows(batches), key=lambda r: r[0]):
            n = chars = loss_chars = 0
            turns, under, valid = hashlib.sha256(), hashlib.sha256(), True

            def pieces(own=own):
                nonlocal chars, valid
                for _, text, loss, good in own:
                    chars, valid = chars + len(text), good
                    yield text, loss

            for role, text, loss in parse(pieces()):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
                if loss:
                    loss_chars += len(text)
                    under.update(text.encode())
            done.append((conv, n, turns.hexdigest(), loss_chars, under.hexdigest(), chars, valid))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), DIGESTS, strict=True)], schema=DIGESTS)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), DIGESTS, strict=True)], schema=DIGESTS)

    return run


def read_back(segments: DataFrame, template: dict = TEMPLATE, ordered: bool = False) -> DataFrame:
    """Per conversation, parsed from its segments (rows of format_chats in any order, written and read or not): counts and digests.

    Segments go by their number; other columns are ignored; no segments give no
    rows. ordered: they come straight from format_chats, which saves an exchange.
    """
    ship(segments.sparkSession)
    own = segments.select("conv_id", "segment", "text", "loss", "valid")
    if not ordered:
        own = own.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return own.mapInArrow(digest_segments(template), DIGESTS_DDL)
