"""Secret scans: fixed base patterns, and a lexer for assignments in source and configuration.

Base spans are whole matches. The lexer walks a text from token to token: comments, strings (with
escapes, in one or three quotes, backticks), names, operators and elements of markup. It parses
name-literal pairs (``name = "x"``, ``"name": "x"``, ``NAME=x``, ``name => x``, ``name := x``,
``<name>x</name>``, ``key="name" value="x"``), joins literals and names that are added or stand side by
side, and keeps what each name holds at that point: a later assignment replaces an earlier one, and a
name used before it is set gets its first value. A value is scored by the names it reaches; the
literals that a value of at least ``SCORE`` is made of are spans of kind ``lexed``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from trendlake.llm.common import column, frugal

KINDS = ("assign", "access", "hex", "lexed")
# The base patterns; ASCII letters only are compared without case.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEX_RUNS = bytes(49 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

# Name parts and how much each makes a literal suspect.
NAME_WEIGHTS = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3,
    "credentials": 3, "privatekey": 3, "accesskey": 3, "auth": 1, "key": 1, "private": 1, "access": 1, "client": 1, "bearer": 2,
}
#: Without what is neither letter nor digit, a text that names nothing of these holds no sensitive name.
_NAME_HINTS = tuple(name.encode() for name in NAME_WEIGHTS)
_OTHER_BYTES = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalnum())
#: Least score of a literal: that of its names, plus 1 where it has a digit.
SCORE = 4
#: A literal has at least so many characters, of so many bits each.
LEAST_CHARS, LEAST_BITS = 8, 2.5
_NAME = r"[^\W\d][\w$]*+(?:[.\-][\w$]++)*+"
_WHOLE_NAME = re.compile(_NAME)
_STEP = re.compile(
    rf"(?P<define>\#define[ \t]++(?={_NAME}[ \t]))|(?P<name>{_NAME})|(?P<op>:=|=>|\+=|[=!<>]=+|=|:)|(?P<quote>(?P<q>[\"'])(?P=q){{2}}|[\"'`])"
    r"|(?P<comment>/\*|<!--|//|\#)|<(?P<tag>[A-Za-z_][\w.:\-]*+)(?=[\s>])|(?P<newline>\n)|[^\S\n]++|."
)
_ASSIGNS = {":=", "=>", "+=", "=", ":"}
_BODY = {q: re.compile(rf"(?:[^{q}\\\n]++|\\.)*+") for q in "\"'"}
_BLANK, _ANY_BLANK = re.compile(r"[ \t]*+"), re.compile(r"\s*+")
_VARIABLE = re.compile(rf"\$(?:\{{({_NAME})\}}|({_NAME}))")
#: A value without quotes: up to the next blank, quote, bracket, comma or semicolon.
_RUN = re.compile(r"[^\s\"'`,;<>(){}\[\]]*+")
_PADDING = re.compile(r"={1,2}(?=[\s\"'`,;<>(){}\[\]]|\Z)")
#: A block of lines behind a colon, and one more line of it.
_BLOCK_LINES = re.compile(r"[ \t]*+[|>][+-]?[ \t]*+\n(?=[ \t])")
_LINE = re.compile(r"([ \t]++)(\S[^\n]*+)\n?")
_REST_OF_TAG = re.compile(r"[^<>]*+>")
#: Calls whose first argument is a name and whose second a value.
_NAMED_CALLS = {"define", "putenv", "setenv", "setproperty", "setattribute"}
_CLOSERS = {"/*": "*/", "<!--": "-->"}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|changeme|example|dummy|none|null|true|false|your.*|<.*>|\$\{?.*)\Z")


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base matches."""
    out = []
    low = raw.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    if b"1" * 32 in raw.translate(_HEX_RUNS):
        out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def name_score(name: str) -> int:
    """How sensitive a target name is: the sum over its parts, neighbours read together first."""
    parts = [p.lower() for p in _PART.findall(name)]
    total, k = 0, 0
    while k < len(parts):
        both = "".join(parts[k : k + 2])
        if k + 1 < len(parts) and both in NAME_WEIGHTS:
            total, k = total + NAME_WEIGHTS[both], k + 2
        else:
            total, k = total + NAME_WEIGHTS.get(parts[k], NAME_WEIGHTS.get(parts[k].removesuffix("s"), 0)), k + 1
    return total


def entropy(counts: Counter) -> float:
    """Bits a character of a literal whose characters were counted."""
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


class Value:
    """What a name holds: one literal, or two values one behind the other. Parts are shared, so a constant that doubles costs nothing."""

    __slots__ = ("counts", "done", "head", "parts", "size", "span")

    def __init__(self, text: str, span: tuple[int, int] | None = None, parts: tuple[Value, ...] = ()):
        self.span, self.parts, self.done = span, parts, False
        if span:
            own = text[span[0] : span[1]]
            self.counts, self.head, self.size = Counter(own), own[:64], len(own)
        else:
            first, second = parts
            self.counts = first.counts + second.counts
            self.head, self.size = (first.head + second.head)[:64], first.size + second.size

    def strength(self) -> int:
        """0 for a placeholder or what is too short or even, 1, or 2 with a digit."""
        if self.size < LEAST_CHARS or entropy(self.counts) < LEAST_BITS or _PLACEHOLDER.match(self.head):
            return 0
        return 1 + any(c.isdigit() for c in self.counts)

    def spans(self) -> Iterator[tuple[int, int]]:
        """The literals that no earlier call has given."""
        todo = [self]
        while todo:
            value = todo.pop()
            if not value.done:
                value.done = True
                todo += value.parts
                if value.span:
                    yield value.span


class Term(NamedTuple):
    """What is assigned: a literal, a constant by its ``name``, or a bare word that may be either."""

    start: int
    end: int
    name: str | None = None
    literal: bool = True


class Lexer:
    """The assignments of one text in order, in time linear in it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.missing: set[str] = set()  # closers that do not come again
        self.run_end = 0
        self.unclosed = {'"': 0, "'": 0}  # ends of lines on which a string was not closed

    def closing(self, closer: str, at: int) -> int:
        if closer in self.missing:
            return -1
        end = self.text.find(closer, at)
        if end < 0:
            self.missing.add(closer)
        return end

    def run(self, at: int) -> int:
        """The end of the run of unquoted characters at ``at``."""
        if at >= self.run_end:
            self.run_end = _RUN.match(self.text, at).end()
        return self.run_end

    def string(self, at: int) -> tuple[int, int, int] | None:
        """Start and end of what the quotes at ``at`` hold, and where they are closed."""
        text, quote = self.text, self.text[at]
        if quote != "`" and text.startswith(quote * 3, at):
            quote *= 3
        begin = at + len(quote)
        if quote in self.unclosed:
            if at < self.unclosed[quote]:
                return None
            end = _BODY[quote].match(text, begin).end()
            if end < len(text) and text[end] == quote:
                return begin, end, end + 1
            self.unclosed[quote] = end
            return None
        end = self.closing(quote, begin)
        while end > begin and text[end - 1] == "\\":
            end = self.closing(quote, end + 1)
        return (begin, end, end + len(quote)) if end >= 0 else None

    def term(self, at: int) -> tuple[Term | None, int]:
        """The term at ``at``, None for a call, an element or no term, and where it ends."""
        text = self.text
        if at >= len(text):
            return None, at
        prefix = 1 if text[at] in "rbuRBU" and text[at + 1 : at + 2] in ('"', "'") else 0
        if text[at + prefix] in "\"'`":
            found = self.string(at + prefix)
            return (Term(*found[:2]), found[2]) if found else (None, at + prefix + 1)
        if m := _VARIABLE.match(text, at):
            return Term(at, m.end(), m[1] or m[2], False), m.end()
        end = self.run(at)
        if end == at:
            return None, at
        name = _WHOLE_NAME.match(text, at)
        if name and name.end() == end:
            return (None if text[end : end + 1] in ("(", "[") else Term(at, end, name[0])), end
        if name and text[name.end()] in ":=" and not _PADDING.match(text, name.end()):
            if text.startswith("://", name.end()):
                return Term(at, end), name.end() + 3  # the address may hold assignments itself
            return Term(at, name.end(), name[0], False), name.end()
        return Term(at, end), end

    def value(self, at: int) -> tuple[list[Term | None], int]:
        """The terms from ``at`` on that are added up or stand side by side, and where they end."""
        text, terms = self.text, []
        at = _BLANK.match(text, at).end()
        inside = text.startswith("(", at)
        blank = _ANY_BLANK if inside else _BLANK
        at = blank.match(text, at + inside).end()
        while True:
            term, at = self.term(at)
            terms.append(term)
            following = blank.match(text, at).end()
            if text.startswith("+", following) and not text.startswith(("+=", "++"), following):
                at = _ANY_BLANK.match(text, following + 1).end()
            elif term and term.name is None and text[term.end : term.end + 1] in ('"', "'") and text[following : following + 1] in ('"', "'"):
                at = following
            else:
                return terms, at

    def pairs(self) -> Iterator[tuple[str, str, list[Term | None]]]:
        """name, operator and terms of each assignment."""
        text, at, left, owner, quoted = self.text, 0, None, None, False
        while at < len(text):
            m = _STEP.match(text, at)
            kind, begin, at = m.lastgroup, at, m.end()
            if kind == "name":
                left, quoted = m[0], False
            elif kind == "define":
                name = _WHOLE_NAME.match(text, at)
                terms, at = self.value(name.end())
                left = None
                yield name[0], "=", terms
            elif kind == "op":
                if left is None or m[0] not in _ASSIGNS:
                    left = None
                    continue
                if m[0] == ":" and (block := _BLOCK_LINES.match(text, at)):
                    at, terms = block.end(), []
                    while line := _LINE.match(text, at):
                        if terms and len(line[1]) < indent:
                            break
                        indent = len(line[1]) if not terms else indent
                        terms.append(Term(line.start(2), line.start(2) + len(line[2].rstrip())))
                        at = line.end()
                    yield left, "=", terms
                    left = None
                    continue
                listed = _BLANK.match(text, at).end()
                if text.startswith("[", listed):
                    at = _ANY_BLANK.match(text, listed + 1).end()
                    while at < len(text) and text[at] in "\"'":
                        terms, at = self.value(at)
                        yield left, "=", terms
                        at = _ANY_BLANK.match(text, at).end()
                        if not text.startswith(",", at):
                            break
                        at = _ANY_BLANK.match(text, at + 1).end()
                    left = None
                    continue
                tight = m[0] == ":" or (m[0] == "=" and text[begin - 1].strip() and text[at : at + 1].strip())
                terms, at = self.value(at)
                single = terms[0] if len(terms) == 1 else None
                if single and single.name and not tight:  # no bare literal of a shell or a configuration
                    terms = [single._replace(literal=False)]
                yield left, m[0], terms
                if left.lower() == "value" and owner:
                    yield owner, m[0], terms
                owner = text[single.start : single.end] if left.lower() in ("key", "name") and single else None
                left = single and single.name  # a target itself in: a = b = "x"
            elif kind == "quote":
                left = None
                found = None if begin and text[begin - 1].isalnum() else self.string(begin)
                if found:
                    name = _WHOLE_NAME.fullmatch(text, *found[:2])
                    left, at, quoted = name and name[0], found[2], True
                else:
                    at = begin + 1
            elif kind == "comment":
                left = None
                if m[0] in _CLOSERS:
                    end = self.closing(_CLOSERS[m[0]], at)
                    at = end + len(_CLOSERS[m[0]]) if end >= 0 else at
                elif not begin or text[begin - 1].isspace():
                    end = self.closing("\n", at)
                    at = end if end >= 0 else len(text)
            elif kind == "tag":
                left = None
                if rest := _REST_OF_TAG.match(text, at):  # attributes are read as pairs of their own
                    end = self.closing("<", rest.end())
                    if end > rest.end() and text.startswith(f"</{m['tag']}>", end):
                        yield m["tag"], "=", [Term(rest.end(), end)]
                        at = end if rest.end() == at + 1 else at
            elif m[0] == "(" and left and begin and not text[begin - 1].isspace():
                last = left.rpartition(".")[2].lower()
                if last in _NAMED_CALLS:
                    first, after = self.term(_ANY_BLANK.match(text, at).end())
                    after = _ANY_BLANK.match(text, after).end()
                    name = first and _WHOLE_NAME.fullmatch(text, first.start, first.end)
                    if name and text.startswith(",", after):
                        terms, at = self.value(_ANY_BLANK.match(text, after + 1).end())
                        yield name[0], "=", terms
                elif last.startswith("set"):
                    term, after = self.term(_ANY_BLANK.match(text, at).end())
                    if term and text.startswith(")", _ANY_BLANK.match(text, after).end()):
                        yield left, "=", [term]
                        at = after
                left = None
            elif kind == "newline" or not (m[0].isspace() or (m[0] == "]" and quoted)):
                left = None


def lexed_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the literals that sensitive names receive."""
    if not any(sign in raw for sign in (b"=", b":", b"</", b"(", b"#define")):
        return []
    squeezed = raw.lower().translate(None, _OTHER_BYTES)
    if not any(hint in squeezed for hint in _NAME_HINTS):
        return []
    held: dict[str, Value | None] = {}
    waiting: dict[str, list[str]] = {}
    scores: dict[str, int] = {}
    out: set[tuple[int, int, int]] = set()

    def receives(name: str, value: Value) -> None:
        if name not in scores:
            scores[name] = name_score(name)
        if scores[name] + 1 < SCORE or value.done:
            return
        strength = value.strength()
        if strength and scores[name] + strength - 1 >= SCORE and not (value.size <= len(value.head) and value.head in held):
            out.update((s, e, 3) for s, e in value.spans())

    for name, op, terms in Lexer(text).pairs():
        value = held.get(name) if op == "+=" else None
        for term in terms:
            more = None
            if term and term.name in held:
                more = held[term.name]
            elif term:
                if term.name:
                    waiting.setdefault(term.name, []).append(name)
                if term.literal:
                    more = Value(text, (term.start, term.end))
            if more:
                value = Value(text, None, (value, more)) if value else more
        held[name] = value
        todo = [name] if value else []
        while todo:
            target = todo.pop()
            receives(target, value)
            todo += waiting.pop(target, [])
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rows = []
        raws = batch.column(1).cast(pa.binary()).to_pylist()
        for k, raw in enumerate(raws):
            base, more = [], []
            if raw:
                text = raw.decode()
                base, more = base_spans(text, raw), lexed_spans(text, raw)
            counts = Counter(s[2] for s in base)
            digest = hashlib.sha256(written(base).encode()).hexdigest() if base else nothing
            rows.append((counts[0], counts[1], counts[2], digest, written(base + more), len(more)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], _NAMES)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and spans of the secrets in every whole text.

    Offsets are code points, ends exclusive. A null or empty text has no spans; texts of any length are
    read whole, in time linear in them; repeated rows get equal results; the null id stays null; other
    columns are not read; an empty table gives no rows.
    """
    chosen = docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"
    return chosen.mapInArrow(frugal(_scan_batches), schema)
