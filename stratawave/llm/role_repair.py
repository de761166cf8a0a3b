"""Conversation structure repair: an error-correcting Earley parser over a weighted role grammar.

A conversation is read as the initials of its roles. Grammars are left-linear
(a nonterminal stands only in front of a rule), as orders of roles are: every
chart item then begins in column 0, so a parser holds two columns, whatever
the conversation's length. Deleting, reroling and inserting are productions
with a cost; an item keeps the least (cost, audit) that leads to it, where the
audit is the initials of the edits so far. Two audits of one cost never are
one another's beginning (more letters cost more), so the least of them stays
the least whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, ship, slices

#: Rules by initials of roles, costs of the edits, and the roles that a row may be given or that may be put in.
GRAMMAR = {
    "start": "talk",
    "rules": [("talk", []), ("talk", ["pairs"]), ("pairs", ["half", "a"]), ("half", ["u"]), ("half", ["lead", "u"]), ("half", ["pairs", "u"]), ("lead", ["s"])],
    "costs": {"rerole": 2, "insert": 2, "delete": 3, "truncated": 1},
    "roles": {"u": "user", "a": "assistant"},
}
#: Columns after which what all items share is put away.
FLUSH = 1024
INFINITE = 1 << 40


class Grammar:
    """Items (rule, dot) of a grammar, numbered, with what each waits for and where it leads."""

    def __init__(self, grammar: dict) -> None:
        rules = [(left, tuple(right)) for left, right in grammar["rules"]]
        heads = {left for left, _ in rules}
        if grammar["start"] not in heads or any(s in heads for _, right in rules for s in right[1:]):
            raise ValueError("every rule is at most one nonterminal and then terminals, and the start has a rule")
        items = [(r, dot) for r, (_, right) in enumerate(rules) for dot in range(len(right) + 1)]
        number = {item: i for i, item in enumerate(items)}
        symbol = [rules[r][1][dot] if dot < len(rules[r][1]) else None for r, dot in items]
        self.costs, self.roles = grammar["costs"], grammar["roles"]
        #: The terminal an item waits for, if it does, and the item after it.
        self.awaits = [s if s is not None and s not in heads else None for s in symbol]
        self.after = [i + 1 for i in range(len(items))]
        #: Complete items: the items of column 0 that waited for their head, moved on. Nothing stood before them, so values carry over.
        self.completes = [[number[r, 1] for r, (_, right) in enumerate(rules) if right and right[0] == rules[items[i][0]][0]] if s is None else [] for i, s in enumerate(symbol)]
        self.final = [s is None and rules[items[i][0]][0] == grammar["start"] for i, s in enumerate(symbol)]
        wanted, todo = set(), [grammar["start"]]
        while todo:
            if (head := todo.pop()) not in wanted:
                wanted.add(head)
                todo += [right[0] for left, right in rules if left == head and right and right[0] in heads]
        self.predicted = [number[r, 0] for r, (left, _) in enumerate(rules) if left in wanted]
        self.gaps = self._gaps()

    def _reach(self, item: int) -> set[int]:
        """Waiting and final items that completing leads to from an item."""
        seen, todo = set(), [item]
        while todo:
            if (i := todo.pop()) not in seen:
                seen.add(i)
                todo += self.completes[i]
        return {i for i in seen if self.awaits[i] or self.final[i]}

    def _gaps(self) -> dict[int, list[tuple[int, int]]]:
        """For item y the (x, gap) for which whatever completes y at some cost completes x at no more than gap above it.

        x follows every move of y: the same row kept, reroled or deleted, the
        same insertion or none; inserting first may bring x into place.
        """
        live = [i for i in range(len(self.awaits)) if self.awaits[i] or self.final[i]]
        then = {i: self._reach(self.after[i]) if self.awaits[i] else set() for i in live}
        gap = {(x, y): 0 if x == y else INFINITE for x in live for y in live}
        rerole, insert, delete = (self.costs[k] for k in ("rerole", "insert", "delete"))
        best = lambda xs, y: min((gap[x, y] for x in xs), default=INFINITE)

        def follow(x, y):
            needs = [0]
            if self.final[y]:
                needs.append(0 if self.final[x] else INFINITE)
            t = self.awaits[y]
            for z in then[y]:
                skip = delete + gap[x, z]
                same = best(then[x], z) if self.awaits[x] == t else INFINITE
                other = best(then[x], z) if self.awaits[x] in self.roles else INFINITE
                needs.append(min(skip, same, rerole + other))
                if t in self.roles:
                    needs += [min(skip - rerole, other), min(same, gap[x, z] - insert if gap[x, z] < INFINITE else INFINITE)]
            moved = insert + best(then[x], y) if self.awaits[x] in self.roles else INFINITE
            return min(max(needs), moved)

        changed = True
        while changed:
            changed = False
            for pair in gap:
                if (g := follow(*pair)) < gap[pair]:
                    gap[pair], changed = g, True
        return {y: [(x, gap[x, y]) for x in live if x != y and gap[x, y] < INFINITE] for y in live}


# An edit chain: (chain before, letter, role initial or '', length). Item values: (cost, chain).


def _before(x, y) -> bool:
    """Whether chain x's letters come before chain y's; both end in one column at one cost."""
    a, b = [], []
    while x is not y:
        if (x[3] if x else 0) >= (y[3] if y else 0):
            a.append(x[1])
            x = x[0]
        else:
            b.append(y[1])
            y = y[0]
    return a[::-1] < b[::-1]


class Repairer:
    """The chart of one conversation: rows go in one by one, finish() gives (cost, audit, initials of the repaired roles)."""

    def __init__(self, grammar: Grammar) -> None:
        self.g, self.done, self.n = grammar, [], 0
        self.column = self._close({i: (0, None) for i in grammar.predicted})

    def _close(self, column: dict) -> dict:
        """Completions and insertions inside a column, then only items that can still win."""
        g, todo = self.g, list(column)
        insert = g.costs["insert"]

        def offer(item, cost, chain):
            old = column.get(item)
            if old is None or cost < old[0] or (cost == old[0] and chain is not old[1] and _before(chain, old[1])):
                column[item] = (cost, chain)
                todo.append(item)

        while todo:
            item = todo.pop()
            cost, chain = column[item]
            for target in g.completes[item]:
                offer(target, cost, chain)
            if (t := g.awaits[item]) in g.roles:
                offer(g.after[item], cost + insert, (chain, "I", t, (chain[3] if chain else 0) + 1))
        return {y: v for y, v in column.items() if y in g.gaps and not any(x in column and column[x][0] + gap < v[0] for x, gap in g.gaps[y])}

    def feed(self, initial: str, must_go: bool, truncated: bool) -> None:
        """One row: initial of its role, whether it must be deleted, whether keeping it costs more."""
        g, column = self.g, {}
        more = g.costs["truncated"] if truncated else 0

        def offer(item, cost, chain):
            old = column.get(item)
            if old is None or cost < old[0] or (cost == old[0] and _before(chain, old[1])):
                column[item] = (cost, chain)

        for item, (cost, chain) in self.column.items():
            length, t = (chain[3] if chain else 0) + 1, g.awaits[item]
            offer(item, cost + g.costs["delete"], (chain, "D", "", length))
            if t and not must_go:
                if t == initial:
                    offer(g.after[item], cost + more, (chain, "K", t, length))
                elif t in g.roles:
                    offer(g.after[item], cost + g.costs["rerole"] + more, (chain, "R", t, length))
        self.column = self._close(column)
        self.n += 1
        if self.n % FLUSH == 0:
            self._flush()

    @staticmethod
    def _text(chain) -> tuple[str, str]:
        letters, roles = [], []
        while chain:
            letters.append(chain[1])
            roles.append(chain[2])
            chain = chain[0]
        return "".join(reversed(letters)), "".join(reversed(roles))

    def _flush(self) -> None:
        """Put away the edits that every item shares, so that chains stay as short as what is still open."""
        shared, *rest = [chain for _, chain in self.column.values()]
        for other in rest:
            while shared is not other:
                if (shared[3] if shared else 0) >= (other[3] if other else 0):
                    shared = shared[0]
                else:
                    other = other[0]
        if shared is None:
            return
        self.done.append(self._text(shared))
        moved = {id(shared): None}  # chains hang together, so each node is moved once

        def rebase(chain):
            path = []
            while id(chain) not in moved:
                path.append(chain)
                chain = chain[0]
            base = moved[id(chain)]
            for node in reversed(path):
                base = moved[id(node)] = (base, node[1], node[2], (base[3] if base else 0) + 1)
            return base

        self.column = {item: (cost, rebase(chain)) for item, (cost, chain) in self.column.items()}

    def finish(self) -> tuple[int, str, str]:
        best = None
        for item, (cost, chain) in self.column.items():
            if self.g.final[item] and (best is None or cost < best[0] or (cost == best[0] and chain is not best[1] and _before(chain, best[1]))):
                best = (cost, chain)
        parts = [*self.done, self._text(best[1])]
        return best[0], "".join(a for a, _ in parts), "".join(r for _, r in parts)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults planted by crc32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3
    repeats it, 4 makes it the user's. Nulls are one space, in the key, role and text
    (turn stays null). Rows without conv_id are left out.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("col")


BLANKS = " \t\n\x0b\f\r"


def fault_of(text: Column, times: Column) -> Column:
    """blank, duplicate (times: how often role and text were seen up to here), truncated or null, whichever comes first."""
    core = F.rtrim(text, F.lit(BLANKS))
    return F.when(core == "", "blank").when(times > 1, "duplicate").when(~F.substring(core, -1, 1).isin(".", "!", "?"), "truncated")


def with_faults(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (from 1), turn, role, text, initial, fault, illegal (an initial that may not follow the one before), new_turn.

    Rows go by turn (nulls first), then role and text; of rows alike in role and
    text all but the first are duplicates. One exchange by conversation serves every window, and
    none of them holds a conversation in memory.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    times = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(order[0]))
    rows = rows.withColumn("times", times)
    own = Window.partitionBy("conv_id").orderBy(*order, "times")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(own), initial)
    before = F.lag("turn").over(own)
    new_turn = F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn")))
    return rows.select("conv_id", F.row_number().over(own).alias("seq"), "turn", "role", "text", initial.alias("initial"), fault_of(F.col("text"), F.col("times")).alias("fault"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), new_turn.alias("new_turn"))


REPAIRS = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])
REPAIRS_DDL = "conv_id long, cost long, audit string, roles string"


def parse_stream(grammar: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(conv_id, initial, fault) by conversation and place -> a row of REPAIRS a conversation; a chart crosses batches, rows do not."""
    g = Grammar(grammar)

    def run(batches):
        conv, chart, out = None, None, []
        for batch in (s for b in batches for s in slices(b, 4096)):
            for own, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault")), strict=True):
                if own != conv:
                    if chart:
                        out.append((conv, *chart.finish()))
                    conv, chart = own, Repairer(g)
                chart.feed(initial, fault in ("blank", "duplicate"), fault == "truncated")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), REPAIRS, strict=True)], schema=REPAIRS)
                out = []
        if chart:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv, *chart.finish()), REPAIRS, strict=True)], schema=REPAIRS)

    return run


def find_repairs(rows: DataFrame, grammar: dict = GRAMMAR) -> DataFrame:
    """Cheapest repair of each conversation of with_faults' rows: conv_id, cost, audit (a letter an edit), roles (an initial a row that is left)."""
    ship(rows.sparkSession)
    return rows.select("conv_id", "seq", "initial", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(parse_stream(grammar), REPAIRS_DDL)


TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
TURNS_DDL = "conv_id long, place long, role string, text string, edit string"


def edit_stream(grammar: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A conversation's repair (seq 0, audit as role, roles as text) and then its rows -> the rows that are left, in order."""
    names = grammar["roles"]

    def run(batches):
        audit, roles, at, place, conv = "", "", 0, 0, None

        def inserted():
            nonlocal at, place
            while at < len(audit) and audit[at] == "I":
                yield conv, place, names[roles[place]], "", "I"
                at, place = at + 1, place + 1

        for batch in (s for b in batches for s in slices(b)):
            out = []
            for own, seq, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "role", "text")), strict=True):
                if seq == 0:
                    conv, audit, roles, at, place = own, role, text, 0, 0
                else:
                    if audit[at] != "D":
                        out.append((conv, place, role if audit[at] == "K" else names[roles[place]], text, audit[at]))
                        place += 1
                    at += 1
                out.extend(inserted())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), TURNS, strict=True)], schema=TURNS)

    return run


def apply_repairs(rows: DataFrame, repairs: DataFrame, grammar: dict = GRAMMAR) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I), by conversation and place within partitions."""
    ship(rows.sparkSession)
    plans = repairs.select("conv_id", F.lit(0).alias("seq"), F.col("audit").alias("role"), F.col("roles").alias("text"))
    both = rows.select("conv_id", "seq", "role", "text").unionByName(plans)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(edit_stream(grammar), TURNS_DDL)


def digest_turns(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` lines of apply_repairs' rows, taken as they stream by; conversations without rows have none."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        conv, digest, out = None, None, []
        for batch in (s for b in batches for s in slices(b)):
            for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if own != conv:
                    if conv is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], schema=schema)

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(originals: DataFrame, conversations: DataFrame, grammar: dict = GRAMMAR) -> DataFrame:
    """Per conv_id of originals: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of conversations' rows.

    conversations: conv_id, turn, role, text without nulls but in turn (damaged
    gives them). Repeated rows count as rows, ties in turn go by role and text,
    other columns are ignored; a conversation without rows has zeros, an empty
    audit and the empty text's digest; an empty table gives no rows.
    """
    rows = cut(with_faults(conversations), "turns")
    n = lambda c: F.count(F.when(c, 1))
    fault = F.col("fault")
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - n(F.col("new_turn")), F.lit(0)).alias("gaps"),
        *[n(fault == k).alias(k) for k in ("blank", "duplicate", "truncated")],
        n(F.col("illegal")).alias("illegal"),
    )
    repairs = cut(find_repairs(rows, grammar), "repairs")
    digests = digest_turns(apply_repairs(rows, repairs, grammar))
    ids = originals.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(counts, "conv_id", "left").join(repairs.select("conv_id", "cost", "audit"), "conv_id", "left").join(digests, "conv_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = cut(joined.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), "repaired")
    forget(rows, repairs)
    return out
