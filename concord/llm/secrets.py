"""Secret scan: assignment-aware lexing beside three fixed patterns.

Source and configuration syntax is read as statements ``name = expression`` (``=``, ``:``, ``:=``, ``=>``), where an
expression is a literal, a name assigned earlier in the text, ``${name}``, or a ``+`` chain of these.  Constants are
propagated, so ``part = "x9f2..."; db_password = part`` reports the literal of ``part``.  A literal is a finding when
the sensitivity of the target name times the strength of the value reaches ``threshold`` and it is not wholly inside a
base span; one that sticks out of a base span is a finding beside it, so masking leaves no tail.

A name keeps a summary of its value (length, kinds and counts of characters) and its literals as a shared list, so a
chain of names costs time in proportion to the text; an operand that an expression holds twice counts once.  Inside an
unquoted value further names are read too (``env: DB_PWD=...``), each with what stands up to the next ``=``, ``&`` or ``:``.

Brackets after a name open a scope: the keys on the way are the target's path, so the quoted items of ``"api_keys": [...]``
and the values of ``{"secret": {"value": ...}}`` reach a telling name; so do the items of a list below ``name:`` and a
value on the next line, if they are one word with a digit in it or stand in quotes.

Edge cases: a null text is the empty text and has no findings (an empty array, never null); the whole text is read
whatever its length; repeated rows each get their own findings; an input column ``findings`` is replaced; every other
column, null or not, passes through untouched; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import text_or_empty

FINDING = "array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>"
#: Kinds in the order in which ties of start are listed.
KINDS = ("assign", "access", "hex", "lexed")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more

#: How telling each word of a target name is.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "pass": 0.8, "auth": 0.6, "bearer": 0.8, "private": 0.6, "access": 0.4, "key": 0.5, "api": 0.4, "signing": 0.5, "client": 0.2, "session": 0.3,
}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|change_?me|todo|your[_-].*|example.*|placeholder.*|<.*>|\{\{.*\}\}|%\w+%)$")
_TARGET = re.compile(r"""(?<![\w.-])([A-Za-z_][\w.-]*+)["']?[ \t]*+(?::=|=>|[=:](?![=:/]))[ \t]*+""", re.A)
_QUOTED = r"""\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|\$\{(\w+)\}|"""
_OPERAND = re.compile(_QUOTED + r"""([^\s"'`,;(){}\[\]<>+]+(?:\+[^\s"'`,;(){}\[\]<>+]+)*)""", re.A)
#: Within an unquoted value that was read already.
_INNER = re.compile(_QUOTED + r"""([^\s"'`,;(){}\[\]<>+=&:]+)""", re.A)
#: A name before a bracket, and what stands within brackets: strings, brackets, other words, signs of keys, ends of values.
_OPEN = re.compile(r"""(?<![\w.-])([A-Za-z_][\w.-]*+)["']?[ \t]*+(?::=|=>|[=:](?![=:/]))\s*+[\[{]""", re.A)
_INSIDE = re.compile(r'''"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([^\s"'`,;(){}\[\]<>=:]++)|([\[{])|([\]}])|([:=])|([,;])''', re.A)
#: A name whose value, or list of values, begins on the next line; an item of such a list.
_BELOW = re.compile(r"""(?<![\w.-])([A-Za-z_][\w.-]*+)["']?[ \t]*+[=:][ \t]*+[|>\\]?-?[ \t]*+\r?\n((?:[ \t]*+-[ \t][^\n]*+(?:\n|\Z))++|[ \t]++[^\s-][^\n]*+)""", re.A)
_ITEM = re.compile(r"""^[ \t]*(?:-[ \t]+)?(?:"([^"\n]*)"|'([^'\n]*)'|((?=[^\s]*[0-9])[^\s"'#,;:(){}\[\]<>]+)),?[ \t\r]*$""", re.M)
_PLURAL = re.compile(r"(?i)(key|token|secret|password|passphrase)s(?![a-z])")
#: Words that join others into a sentence.
JOINING = frozenset("a an and are as at be by can do for from have if in into is it must no not of on or should that the this to use was when with you your".split())
#: How telling a path must be for what it holds to count.
TELLING = 0.8
_PLUS = re.compile(r"[ \t]*\+[ \t]*(?=[\"'`$\w])")
_PLAIN = re.compile(r"[A-Za-z]?[a-z]*[.,;:!?]*|[0-9]+[.,;:!?]*", re.A)
_KINDS = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]")))
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", re.A)


def sensitivity(name: str) -> float:
    """0 to 1: how likely the name is one of a secret."""
    words = [w.lower() for w in _NAME_WORDS.findall(name)]
    return min(1.0, sum(WEIGHTS.get(w, 0.0) for w in dict.fromkeys(words)))


class Value:
    """What an expression is made of: counts of characters by code point modulo 128, kinds of characters, its literals.

    ``literals`` holds spans and other values; ``told`` marks those whose literals were reported already; ``weak`` is 0 for
    what may be a credential, 1 for what may be a passphrase, 2 for what is neither."""

    __slots__ = ("counts", "kinds", "literals", "told", "weak")

    def __init__(self):
        self.counts: Counter = Counter()
        self.kinds, self.weak, self.told = 0, 2, False
        self.literals: list = []

    def add(self, text: str, span: tuple[int, int]) -> None:
        literal = text[span[0] : span[1]]
        self.counts.update(ord(c) & 127 for c in literal)
        self.kinds |= sum(bool(p.search(literal)) << i for i, p in enumerate(_KINDS))
        words = literal.split()
        # a sentence, and what stands for a value, tell nothing; words with a number but none that joins them may be a passphrase
        prose = len(words) > 1 and 2 * sum(bool(_PLAIN.fullmatch(w)) for w in words) >= len(words)
        phrase = prose and len(words) > 3 and any(c in "0123456789" for c in literal) and JOINING.isdisjoint(w.lower().strip(".,;:!?") for w in words)
        self.weak = min(self.weak, 2 if (prose and not phrase) or _PLACEHOLDER.match(literal) else int(phrase))
        self.literals.append(span)

    def take(self, other: Value) -> None:
        self.counts.update(other.counts)
        self.kinds |= other.kinds
        self.weak = min(self.weak, other.weak)
        self.literals.append(other)
        if (n := self.counts.total()) > 1 << 20:  # far above what any strength asks for: only the shares matter now
            self.counts = Counter({c: max(1, (k << 16) // n) for c, k in self.counts.items()})

    def strength(self, full: bool = False) -> float:
        """0 to 1: how much the value looks like a credential; grows with its entropy in bits.

        Passphrases count only under a name of full weight (``full``)."""
        n = self.counts.total()
        if n < 6 or self.weak > full:
            return 0.0
        bits = -sum(c * math.log2(c / n) for c in self.counts.values())
        return min(1.0, bits / 40 + 0.15 * (self.kinds.bit_count() - 1))

    def report(self) -> list[tuple[int, int]]:
        """Spans of all literals that no earlier call has given, in order."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                out.append(x)
            elif not x.told:
                x.told = True
                todo += reversed(x.literals)
        return out


def strength(value: str, full: bool = False) -> float:
    """Strength of a single literal."""
    v = Value()
    v.add(value, (0, len(value)))
    return v.strength(full)


def lexed(text: str, threshold: float = 0.45) -> list[tuple[int, int, str, float]]:
    """(start, end, target name, score) of every literal that reaches a sensitive name; each literal once."""
    known: dict[str, Value] = {}
    found: list[tuple[int, int, str, float]] = []
    read = 0  # end of the last unquoted value
    for m in _TARGET.finditer(text):
        name, at, value, held = m[1], m.end(), Value(), set()
        while o := (_INNER if at < read else _OPERAND).match(text, at):
            kind = o.lastindex
            ref = o[kind].rstrip(".") if kind >= 4 else None
            if ref is not None and ref in known:
                if id(known[ref]) not in held:
                    held.add(id(known[ref]))
                    value.take(known[ref])
            elif kind == 4:
                break
            else:
                value.add(text, o.span(kind))
            at = o.end()
            if kind == 5:
                read = max(read, at)
            if not (p := _PLUS.match(text, at)):
                break
            at = p.end()
        if not value.literals:
            continue
        known[name] = value
        if (s := sensitivity(name)) and (score := s * value.strength(s == 1)) >= threshold:
            found += [(a, b, name, round(score, 6)) for a, b in value.report() if b > a]
    return found


def scoped(text: str, threshold: float = 0.45) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of strings in brackets or on the lines below a telling name; each part of the text is walked once.

    Of a path only its telling words are kept, so depth costs nothing; its first and last keys are the name."""
    found: list[tuple[int, int, str, float]] = []
    told = lambda name: {w.lower() for w in _NAME_WORDS.findall(_PLURAL.sub(r"\1", name))} & WEIGHTS.keys()

    def value(words: set[str], name: str, a: int, b: int) -> None:
        s = min(1.0, math.fsum(WEIGHTS[w] for w in words))
        if s >= TELLING and (score := s * strength(text[a:b], s == 1)) >= threshold:
            found.append((a, b, name, round(score, 6)))

    at = 0
    while m := _OPEN.search(text, at):
        at = m.end()
        if not (words := told(m[1])):
            continue
        path, key, last = [words], "", None
        for t in _INSIDE.finditer(text, at):
            kind = t.lastindex
            if kind == 7:  # what stood before was a key
                key, last = text[slice(*last[:2])] if last else "", None
                continue
            if last and last[2]:
                value(path[-1] | told(key), f"{m[1]}.{key}" if key else m[1], *last[:2])
            last = (*t.span(kind), kind < 4) if kind < 5 else None
            if kind == 5:
                path.append(path[-1] | told(key))
            elif kind == 6:
                path.pop()
            key = key if kind < 5 else ""
            if not path:
                at = t.end()
                break
        else:
            break
    for m in _BELOW.finditer(text):
        if words := told(m[1]):
            for item in _ITEM.finditer(text, m.start(2), m.end(2)):
                value(words, m[1], *item.span(item.lastindex))
    return found


def findings(text: str, threshold: float = 0.45) -> list[tuple]:
    """All findings of a text by start, then kind: (kind, start, end, name, score).  Base ones always stay, lexed ones
    are those that are not wholly inside a base one."""
    base = [("assign", m.start(), m.end(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end(), None, 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", m.start(), m.end(), None, 1.0) for m in HEX.finditer(text)]
    starts, ends = [], []  # base spans by start, with the farthest end so far
    for _, a, b, _, _ in sorted(base, key=lambda x: x[1]):
        starts.append(a)
        ends.append(max(b, ends[-1]) if ends else b)
    inside = lambda a, b: (i := bisect_right(starts, a)) > 0 and ends[i - 1] >= b
    more = []
    if "=" in text or ":" in text:
        named = lexed(text, threshold)
        held = {x[:2] for x in named}
        more = [("lexed", a, b, n, s) for a, b, n, s in named + [x for x in scoped(text, threshold) if x[:2] not in held] if not inside(a, b)]
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(threshold: float):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
    names = ("kind", "start", "end", "name", "score")

    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, f, strict=True)) for f in findings(x.as_py() or "", threshold)] for x in texts], type=kind)

    return F.arrow_udf(scan, FINDING)


def scan_secrets(df: DataFrame, text: str = "text", threshold: float = 0.45) -> DataFrame:
    """``df`` with ``findings``: kind, start, end (code points, end exclusive), name of the target, score."""
    return df.withColumn("findings", _scan(threshold)(text_or_empty(text)))


def masked(text: str, found: list[tuple]) -> str:
    """``text`` with ``[kind]`` in place of each finding; overlapping ones become one mark, that of the first."""
    done, parts = 0, []
    for kind, a, b, *_ in found:
        if b > done:
            parts += [text[done : max(done, a)], f"[{kind}]" if a >= done else ""]
            done = b
    return "".join([*parts, text[done:]])


def redact_secrets(df: DataFrame, text: str = "text", threshold: float = 0.45) -> DataFrame:
    """``df`` with each finding in ``text`` masked, found and replaced in one pass; a null text stays null.

    Only texts with findings come back from the pass, the others stay as they are."""

    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            found = findings(t, threshold) if (t := x.as_py()) else ()
            out.append(masked(t, found) if found else None)
        del texts
        pa.default_memory_pool().release_unused()
        return pa.array(out, type=pa.string())

    return df.withColumn(text, F.coalesce(F.arrow_udf(scan, "string")(text), F.col(text)))


def joined(of: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
