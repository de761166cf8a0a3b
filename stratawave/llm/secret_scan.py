"""Secret scans: a trigram inverted index over documents narrows what each rule's regex must verify.

Every Arrow batch becomes an index segment: one pass over its bytes turns each
place into a trigram code, keeps the codes that some rule's query names, and
sorts them into postings (code, then document). A rule's Boolean query (any of:
all of) intersects and unites postings; only the documents left are verified by
the regex. Rules without mandatory trigrams scan every document. Texts never
leave their task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, doc_rows, ship, slices


@dataclass(frozen=True)
class Rule:
    """kind; pattern; what must be long enough (a group of the match) and how long; whether letters match in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False


#: The base rules, in the order of the report.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: What is scanned for besides.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 64),
    # Runs are taken whole and only from their beginning, so that no text is read more than a few times.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+", 0, 40),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)


def literal_runs(pattern: str) -> list[list[str]]:
    """Alternatives of literal runs that every match contains: any of (all of). Empty: nothing is mandatory.

    Walks the parsed regex: a literal extends the run, an optional single
    character forks it, an alternation multiplies the alternatives, anything
    else ends it.
    """
    from re import _constants as C
    from re import _parser as P

    def walk(items, states):
        # a state: (finished runs, run in progress)
        for op, arg in items:
            if op is C.LITERAL:
                states = [(done, run + chr(arg)) for done, run in states]
            elif op is C.SUBPATTERN:
                states = walk(arg[3], states)
            elif op is C.BRANCH:
                states = [s for branch in arg[1] for s in walk(branch, states)]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1 and len(arg[2]) == 1 and arg[2][0][0] is C.LITERAL:
                states = states + walk(arg[2], states)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                states = [((*done, run), "") for done, run in walk(arg[2], states)]
            else:
                states = [((*done, run), "") for done, run in states]
        return states

    found = [[*done, run] for done, run in walk(P.parse(pattern), [((), "")])]
    return [[r for r in runs if len(r) >= 3] for runs in found]


def trigram_query(rule: Rule) -> list[frozenset[bytes]] | None:
    """Any of these sets of trigrams (bytes) must be in a document, all of the set; None: scan fully. Lower case if the rule folds case."""
    sets = []
    for runs in literal_runs(rule.pattern):
        raw = [(r.lower() if rule.fold else r).encode() for r in runs]
        own = frozenset(r[i : i + 3] for r in raw for i in range(len(r) - 2))
        if not own:
            return None
        sets.append(own)
    return sorted(set(sets), key=sorted)


#: A-Z as a-z.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class TrigramIndex:
    """Postings of given trigrams in a segment of texts."""

    def __init__(self, trigrams: list[bytes]):
        self.number = {g: k for k, g in enumerate(sorted(trigrams), 1)}
        self.table = np.zeros(1 << 24, np.uint8 if len(trigrams) < 256 else np.uint16)
        for g, k in self.number.items():
            self.table[int.from_bytes(g, "big")] = k

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Per trigram the places of the texts that hold it, in order."""
        buf = np.frombuffer(b"\0\0".join([*texts, b"", b""]), np.uint8)  # what spans two texts can only add candidates
        code = buf[:-2].astype(np.int32)
        code <<= 8
        code |= buf[1:-1]
        code <<= 8
        code |= buf[2:]
        found = self.table[code]
        at = np.flatnonzero(found)
        doc = np.searchsorted(np.cumsum([len(t) + 2 for t in texts]), at, side="right")
        keys = np.unique(found[at].astype(np.int64) * len(texts) + np.minimum(doc, len(texts) - 1))
        edges = np.searchsorted(keys, np.arange(1, len(self.number) + 2) * len(texts))
        return {g: keys[edges[k - 1] : edges[k]] - k * len(texts) for g, k in self.number.items()}


class Segments:
    """The rules' queries, and the index over the trigrams that they name, of texts as they are and with A-Z folded."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = {r.kind: (r.fold, trigram_query(r)) for r in rules}
        self.index = {fold: TrigramIndex(sorted({g for f, query in self.queries.values() if f == fold for own in query or () for g in own})) for fold in (False, True)}

    def candidates(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Texts (places in the list) that each rule must verify."""
        postings = {fold: index.postings([t.translate(FOLD) for t in texts] if fold else texts) for fold, index in self.index.items() if index.number}
        out = {}
        for kind, (fold, query) in self.queries.items():
            hits = np.arange(len(texts)) if query is None else np.zeros(0, np.int64)
            for own in query or ():
                first, *rest = sorted((postings[fold][g] for g in own), key=len)
                for other in rest:
                    first = np.intersect1d(first, other, assume_unique=True)
                hits = np.union1d(hits, first)
            out[kind] = hits
        return out


def find_spans(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; those too short are dropped after matching."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


SPANS_DDL = "doc_id long, spans array<struct<kind:string,start:long,stop:long>>"
SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))])


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...]) -> Callable[[list[str]], list[list[tuple[int, int, int]]]]:
    """texts -> per text (start, number of the rule, stop), sorted."""
    compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0)) for r in rules]
    segments = Segments(rules)

    def scan(texts):
        out = [[] for _ in texts]
        raw = [t.encode() for t in texts]
        for a, b in by_bytes(raw):
            must = segments.candidates(raw[a:b])
            for k, (rule, regex) in enumerate(zip(rules, compiled, strict=True)):
                for i in (a + must[rule.kind]).tolist():
                    out[i] += [(x, k, y) for x, y in find_spans(rule, regex, texts[i])]
        return [sorted(x) for x in out]

    return scan


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Per row of docs: doc_id and spans (kind, start, stop in code points, stop exclusive), by start, then by the rules' order.

    Null texts are empty and have no spans; rows without doc_id are left out;
    repeated rows are each scanned; other columns are ignored; an empty table
    gives no rows. Spans of different rules may overlap and all stay.
    """
    ship(docs.sparkSession)
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in (s for b in batches for s in slices(b)):
            found = scan(batch.column(1).to_pylist())
            spans = [[{"kind": kinds[k], "start": a, "stop": b} for a, k, b in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS.field(1).type)], schema=SPANS)

    return doc_rows(docs).mapInArrow(run, SPANS_DDL)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mark (overlapping spans by one), n_chars set anew where the column exists.

    All rows stay, repeated ones each and those without doc_id too; null texts
    stay null; an empty table stays empty; other columns are not touched.
    """
    ship(docs.sparkSession)
    place = docs.columns.index("text")

    def clean(text, spans):
        parts, at = [], 0
        for start, _, stop in spans:
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, stop)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in (s for b in batches for s in slices(b, 256)):
            texts = batch.column(place).to_pylist()
            found = scan(["" if t is None else t for t in texts])
            out = [clean(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    cleaned = docs.mapInArrow(run, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
