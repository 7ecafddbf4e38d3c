"""The text form of typed values: {a,b} for records, [a,b] for sequences, tag^value for unions, quoted strings.

Newlines in strings are written raw and read raw or as an escape.  Reals are read in every form that the writer has, exponents included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from amberlog.sources.typed import Kind, real_text

_INT = re.compile(r"-?\d+")
_REAL = re.compile(r"[+-]?(?:Infinity|NaN|\d*\.?\d*(?:[eE][+-]?\d+)?)")
_SPACE = re.compile(r"\s*")
_PLAIN = re.compile(r'[^"\\]*')
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def write(value, kind: Kind) -> str:
    k = kind.name
    if k == "none":
        return ""
    if k == "boolean":
        return "t" if value else "f"
    if k == "real":
        return real_text(value)
    if k == "sstring":
        return '"' + (value or "").replace("\\", "\\\\").replace('"', '\\"') + '"'
    if k == "record":
        if len(value) != len(kind.parts):
            raise ValueError("wrong number of fields")
        return "{" + ",".join(write(v, t) for v, (_, t) in zip(value, kind.parts, strict=True)) + "}"
    if k == "sequence":
        return "[" + ",".join(write(v, kind.element) for v in value) + "]"
    if k == "union":
        tag, inner = value
        if not 0 <= tag < len(kind.parts):
            raise ValueError("no such variant")
        return f"{tag}^{write(inner, kind.parts[tag][1])}"
    if k == "fstring":
        raise ValueError("fstring has no text form")
    return str(value)


def is_simple(kind: Kind) -> bool:
    """Whether a value stays on one line when written readably: atoms, strings and records of them."""
    return kind.name not in ("sequence", "union", "record") or kind.name == "record" and all(t.name not in ("sequence", "union", "record") for _, t in kind.parts)


def write_pretty(value, kind: Kind, level: int = 0, indent: int = 4) -> str:
    """Records and sequences with a line per part, indented, down to values that are simple."""
    if is_simple(kind) or kind.name not in ("record", "sequence", "union"):
        return write(value, kind)
    if kind.name == "union":
        return f"{value[0]}^{write_pretty(value[1], kind.parts[value[0]][1], level, indent)}"
    parts = [write_pretty(v, t, level + 1, indent) for v, (_, t) in zip(value, kind.parts, strict=True)] if kind.name == "record" else [write_pretty(v, kind.element, level + 1, indent) for v in value]
    pad, (a, b) = "\n" + " " * indent * (level + 1), "{}" if kind.name == "record" else "[]"
    return a + ",".join(pad + p for p in parts) + ("\n" + " " * indent * level if parts else "") + b


def write_flow(values: Iterator, kind: Kind) -> Iterator[str]:
    """A flow of values as the pieces of one text sequence."""
    yield "["
    for i, v in enumerate(values):
        yield ("," if i else "") + write(v, kind)
    yield "]"


class Reader:
    """Reads values from a text, one after the other."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def skip(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self) -> str:
        self.skip()
        return self.text[self.at : self.at + 1]

    def take(self, sign: str) -> None:
        if self.peek() != sign:
            raise ValueError(f"{sign} expected at {self.at}")
        self.at += 1

    def _match(self, pattern: re.Pattern) -> str:
        self.skip()
        m = pattern.match(self.text, self.at)
        if not m or not m[0]:
            raise ValueError(f"no number at {self.at}")
        self.at = m.end()
        return m[0]

    def string(self) -> str:
        self.take('"')
        out = []
        while True:
            m = _PLAIN.match(self.text, self.at)
            out.append(m[0])
            self.at = m.end() + 1
            if self.at > len(self.text):
                raise ValueError("a string does not end")
            if self.text[m.end()] == '"':
                return "".join(out)
            c = self.text[self.at : self.at + 1]
            out.append(_ESCAPES.get(c, c))
            self.at += 1

    def items(self, a: str, b: str) -> Iterator[int]:
        """Positions of the parts between two brackets."""
        self.take(a)
        if self.peek() == b:
            self.at += 1
            return
        i = 0
        while True:
            yield i
            i += 1
            if self.peek() == b:
                self.at += 1
                return
            self.take(",")

    def value(self, kind: Kind):
        k = kind.name
        if k == "none":
            return None
        if k == "character":
            self.at += 1
            return self.text[self.at - 1]
        if k == "boolean":
            self.skip()
            self.at += 1
            return self.text[self.at - 1 : self.at] == "t"
        if k == "real":
            return float(self._match(_REAL))
        if k == "sstring":
            return self.string()
        if k == "record":
            out = tuple(self.value(kind.parts[i][1]) for i in self.items("{", "}"))
            if len(out) != len(kind.parts):
                raise ValueError("wrong number of fields")
            return out
        if k == "sequence":
            return [self.value(kind.element) for _ in self.items("[", "]")]
        if k == "union":
            tag = int(self._match(_INT))
            self.take("^")
            return (tag, self.value(kind.parts[tag][1]))
        if k in ("integer", "longinteger", "byte"):
            return int(self._match(_INT))
        raise ValueError(f"{k} has no text form")


def read(text: str, kind: Kind):
    return Reader(text).value(kind)


def read_flow(text: str, element: Kind) -> Iterator:
    """The elements of a text sequence one by one."""
    r = Reader(text)
    for _ in r.items("[", "]"):
        yield r.value(element)


_MARKS = re.compile(r'["\\\[\]{},]')


def elements(pieces: Iterator[str]) -> Iterator[str]:
    """The texts of the elements of one sequence that comes in pieces; no more than an element and a piece are held."""
    held: list[str] = []  # of the element that is open
    depth, quoted, escaped, empty = 0, False, False, True
    for piece in pieces:
        begin = at = 0
        while at < len(piece):
            if escaped:
                escaped, at = False, at + 1
                continue
            m = _MARKS.search(piece, at)
            if not m:
                break
            c, at = m[0], m.end()
            if quoted:
                escaped, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "[{":
                depth += 1
                if depth == 1:
                    begin = at
            elif c in "]}" or c == "," and depth == 1:
                if depth == 1:
                    held.append(piece[begin : at - 1])
                    text = "".join(held)
                    held, begin = [], at
                    if c == "," or not empty or text.strip():
                        yield text
                    empty = False
                if c != ",":
                    depth -= 1
                    if not depth:
                        return
        if depth:
            held.append(piece[begin:])
    raise ValueError("a sequence does not end")


def read_pieces(pieces: Iterator[str], element: Kind) -> Iterator:
    """The elements of a text sequence that comes in pieces, one by one."""
    return (read(text, element) for text in elements(pieces))
