"""Secret scans by assignment-aware lexing.

Base patterns find assignments to a few names, access keys and runs of hex digits.
The lexer then reads the text as source or configuration: it takes name-literal
pairs from assignments, keyword arguments, dictionary entries, YAML with its blocks,
dotenv and XML elements. When all pairs are known, constants are followed through names
and through +: a name stands for what was assigned to it last before, or else first
after, and names that stand for each other for nothing. Each literal is scored by how
sensitive the name it ends up under is, and by the value itself. Literals that score
enough and that no base span covers are added, where they stand.

A null or empty text has no spans. Repeated rows are scanned each; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, packed, table

#: The kinds in their order, the base patterns and their least lengths.
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 characters or more
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Without one of these, in lower case, a text has no assignment to find.
ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of names and how sensitive they make a name; several parts must stand side by side.
SENSITIVE = {
    ("password",): 1.0, ("passwd",): 1.0, ("passphrase",): 1.0, ("pwd",): 0.9, ("pass",): 0.8, ("secret",): 0.9, ("secrets",): 0.7,
    ("token",): 0.8, ("apikey",): 1.0, ("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 0.9, ("signing", "key"): 0.9,
    ("encryption", "key"): 0.9, ("account", "key"): 0.8, ("auth", "key"): 0.8, ("credential",): 0.8, ("credentials",): 0.8, ("bearer",): 0.7,
    ("auth",): 0.5,
}
#: Parts that say that a name holds something about a secret, not the secret.
ABOUT = {"count", "length", "len", "size", "max", "min", "limit", "type", "name", "id", "url", "uri", "path", "file", "field", "policy", "hash", "expiry", "ttl", "timeout"}
LEXER_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
PLACEHOLDER = re.compile(r"(?i)change.?me|example|placeholder|your[_-]|x{4,}|\*{3,}|\.{3}|^<.*>$|\$\{|\{\{|%\(|^(none|null|true|false|undefined|string|str)$")
ENOUGH = 1.2

HEAD = re.compile(
    r"""(?P<quote>["'`]?)(?P<name>[A-Za-z_][\w.-]{0,63})(?P=quote)\]?[ \t]{0,8}(?::[ \t]{0,8}[A-Za-z_][\w.\[\]]{0,63}[ \t]{0,8}=(?![=>])|:=|=>|=(?!=)|:(?!:))[ \t]{0,8}"""
    r"""|<(?P<tag>[A-Za-z_][\w.-]{0,63})>""",
    re.A,
)
#: A value is scored by so many characters of its beginning, which keeps the lexer linear in the text; its spans are whole.
SCORED = 1024
_BARE = r'''[^\s"'`,;(){}<>\]]'''
QUOTED = re.compile(r'''"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`''')
BARE = re.compile(f"{_BARE}++")
TRIPLE = ('"""', "'''")
NAME = re.compile(r"[A-Za-z_][\w.-]{0,63}", re.A)
BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*\n")
CLOSING = re.compile(r"</([A-Za-z_][\w.-]{0,63})>", re.A)
PLUS = re.compile(r"[ \t]{0,8}\+\s{0,8}")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> float:
    parts = [x.lower() for x in PART.findall(name)]
    if ABOUT & set(parts[-1:]):
        return 0.0
    return max((w for key, w in SENSITIVE.items() for i in range(len(parts)) if tuple(parts[i : i + len(key)]) == key), default=0.0)


def literal_weight(value: str) -> float:
    if len(value) < 6 or PLACEHOLDER.search(value):
        return -1.0
    counts = Counter(value)
    shares = [n / len(value) for n in counts.values()]
    entropy = -sum(p * math.log2(p) for p in shares)
    kinds = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if value.startswith("-----BEGIN "):
        return 0.5
    return 0.2 * (len(value) >= 8) + 0.3 * (entropy >= 3) + 0.1 * any(map(str.isdigit, counts)) + 0.2 * (kinds >= 3) - 0.5 * value.isalpha() - 0.5 * (" " in value)


class Term:
    """A literal, or a name that may stand for other terms, and the term joined to it by +."""

    __slots__ = ("constant", "name", "rest", "said", "seen", "span")

    def __init__(self, span: tuple[int, int], said: str, name: str | None = None):
        self.span, self.said, self.name, self.constant, self.rest, self.seen = span, said, name, None, None, False


class Expressions:
    """Reads the expressions of a text; those that share an end share its terms, and a bare run is searched once."""

    def __init__(self, text: str):
        self.text, self.terms, self.run, self.without = text, {}, (0, 0), set()
        self.lines: tuple[list[int], list[int]] | None = None

    def _literal(self, a: int, b: int, name: str | None = None) -> Term:
        return Term((a, b), self.text[a : min(b, a + SCORED)], name)

    def _term(self, at: int) -> tuple[Term, int] | None:
        text = self.text
        for mark in TRIPLE:
            if text.startswith(mark, at) and mark not in self.without:
                end = text.find(mark, at + 3)
                if end >= 0:
                    return self._literal(at + 3, end), end + 3
                self.without.add(mark)  # none from here on
        if m := QUOTED.match(text, at):
            return self._literal(*m.span(m.lastindex or 1)), m.end()
        if not self.run[0] <= at < self.run[1]:
            if not (m := BARE.match(text, at)):
                return None
            self.run = m.span()
        if text[at] == "+":
            return None
        b = self.run[1]
        return self._literal(at, b, text[at:b] if b - at <= 64 and NAME.fullmatch(text, at, b) else None), b

    def read(self, at: int) -> Term | None:
        first = last = None
        while True:
            term, end = self.terms.get(at), -1
            if term is None and (found := self._term(at)):
                term, end = found
                self.terms[at] = term
            if term is None:
                return first
            if last is None:
                first = term
            else:
                last.rest = term
            if end < 0 or not (more := PLUS.match(self.text, end)):
                return first
            last, at = term, more.end()

    def block(self, head: int, at: int) -> Term | None:
        """The lines below one that ends in a block's mark, as far as they are indented more."""
        if not (m := BLOCK.match(self.text, at)):
            return None
        starts, bodies = self._lines()
        a, b = bodies[bisect_right(starts, head) - 1]
        return self._literal(a, b) if a < b else None

    def _lines(self) -> tuple[list[int], list[tuple[int, int]]]:
        """Where the lines begin that aren't blank, and from where to where those below each stand that are indented more."""
        if self.lines is None:
            starts, bodies, open_ = [], [], []
            at = last = 0
            for line in self.text.split("\n"):
                body = line.strip()
                if body:
                    deep = len(line) - len(line.lstrip())
                    while open_ and open_[-1][0] >= deep:
                        i = open_.pop()[1]
                        bodies[i] = (bodies[i][0], last)
                    if starts and bodies[-1][0] < 0:
                        bodies[-1] = (at + deep, 0)  # the next line's text
                    open_.append((deep, len(starts)))
                    starts.append(at)
                    bodies.append((-1, 0))
                    last = at + deep + len(body)
                at += len(line) + 1
            for _, i in open_:
                bodies[i] = (bodies[i][0] if bodies[i][0] >= 0 else last, last)
            self.lines = starts, bodies
        return self.lines


def _beginning(head: Term, known: dict[Term, str]) -> str:
    """The first SCORED characters of an expression's value; a name that is being followed already stands for nothing."""
    work, busy = [head], set()
    while work:
        now = work[-1]
        if now in known:
            work.pop()
            continue
        busy.add(now)
        parts, room, x = [], SCORED, now
        while x and room > 0:
            if x.constant is None:
                said = x.said
            elif x.constant in known:
                said = known[x.constant]
            elif x.constant in busy:
                said = ""
            else:
                work.append(x.constant)
                break
            parts.append(said[:room])
            room -= len(parts[-1])
            x = x.rest
        else:
            known[now] = "".join(parts)
            busy.discard(now)
            work.pop()
    return known[head]


def _spans(term: Term) -> Iterator[tuple[int, int]]:
    """Where the literals of a term and of all behind it stand, but for those that were given before."""
    left = [term]
    while left:
        x = left.pop()
        while x and not x.seen:
            x.seen = True
            if x.constant:
                left.append(x.constant)
            elif x.span[0] < x.span[1]:
                yield x.span
            x = x.rest


def _pairs(text: str) -> tuple[list[tuple[int, str, Term]], dict[int, Term]]:
    """(start, name, value) of all assignments, and all terms by their places."""
    read = Expressions(text)
    closing: dict[str, list[int]] | None = None
    out = []
    for m in HEAD.finditer(text):
        if m["tag"]:
            if closing is None:
                closing = {}
                for x in CLOSING.finditer(text):
                    closing.setdefault(x[1], []).append(x.start())
            ends = closing.get(m["tag"], [])
            i = bisect_left(ends, m.end())
            if i < len(ends):
                out.append((m.start(), m["tag"], Term((m.end(), ends[i]), text[m.end() : min(ends[i], m.end() + SCORED)])))
        elif term := read.block(m.start(), m.end()) or read.read(m.end()):
            out.append((m.start(), m["name"], term))
    return out, read.terms


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, in their order, each once."""
    pairs, terms = _pairs(text)
    heads = [start for start, _, _ in pairs]
    places: dict[str, tuple[list[int], list[Term]]] = {}
    for start, name, term in pairs:
        at, values = places.setdefault(name, ([], []))
        at.append(start)
        values.append(term)
    for place, term in terms.items():
        if term.name in places:
            at, values = places[term.name]
            own = bisect_left(heads, place) - 1
            i = bisect_left(at, place) - 1
            if i >= 0 and at[i] == heads[own]:  # the assignment that the name stands in
                i -= 1
            if i < 0:
                i = bisect_left(at, place)
            if 0 <= i < len(at):
                term.constant = values[i]
    known: dict[Term, str] = {}
    found = set()
    for _, name, term in pairs:
        weight = name_weight(name)
        if weight and (value := _beginning(term, known)) and weight + literal_weight(value) >= ENOUGH:
            found.update(_spans(term))
    return sorted(found)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all spans, by start, then kind; code points, end exclusive."""
    low = text.lower()
    found = []
    if any(x in low for x in ASSIGN_STEMS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if any(x in low for x in LEXER_STEMS):
        starts = sorted(found)
        reach = list(accumulate((e for _, e, _ in starts), max))  # how far spans that start here or before go
        for a, b in lexed_spans(text):
            i = bisect_right(starts, (a, len(text) + 1, 0)) - 1
            if i < 0 or reach[i] < b:
                found.append((a, b, 3))
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in secret_spans(x or "")] for x in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, kind)], names=["_row", "_spans"])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scanned(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep as _row, and _spans (kind, start, end) of each whole text."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if keep is None or c in keep])
    rows = docs.select(packed(kept), docs[text].alias("_text"))
    return rows.mapInArrow(_scanner, T.StructType([rows.schema["_row"], T.StructField("_spans", SPANS)]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row, spans in zip(batch.column("_row").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
            spans = [(x["start"], x["end"], KINDS.index(x["kind"])) for x in spans]
            base = [x for x in spans if x[2] < 3]
            counts = [sum(x[2] == k for x in spans) for k in range(4)]
            rows.append((row["doc_id"], *counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), counts[3]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"]
        )


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.mapInArrow(_digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")
