"""The binary form of typed values: little-endian atoms, strings with a 7-bit length, sequences with a 64-bit count, unions with a tag byte."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable

from amberlog.sources.typed import Kind

_ATOMS = {"boolean": "<?", "byte": "<B", "integer": "<i", "longinteger": "<q", "real": "<d"}


def _length(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def write(value, kind: Kind) -> bytes:
    k = kind.name
    if k in _ATOMS:
        return struct.pack(_ATOMS[k], value)
    if k == "none":
        return b""
    if k == "character":
        return value.encode()
    if k == "sstring":
        data = (value or "").encode("utf-8", "surrogatepass")
        return _length(len(data)) + data
    if k == "record":
        if len(value) != len(kind.parts):
            raise ValueError("wrong number of fields")
        return b"".join(write(v, t) for v, (_, t) in zip(value, kind.parts, strict=True))
    if k == "sequence":
        return struct.pack("<q", len(value)) + b"".join(write(v, kind.element) for v in value)
    if k == "union":
        tag, inner = value
        if not 0 <= tag < len(kind.parts):
            raise ValueError("no such variant")
        return bytes([tag]) + write(inner, kind.parts[tag][1])
    raise ValueError(f"{k} has no binary form")


class Reader:
    """Reads values from bytes or from a stream, one after the other; of a stream no more is held than a value needs."""

    def __init__(self, data, at: int = 0):
        self.stream = data if hasattr(data, "read") else io.BytesIO(data)
        if at:
            self.stream.seek(at)

    def _bytes(self, n: int) -> bytes:
        out = self.stream.read(n)
        while len(out) < n:
            more = self.stream.read(n - len(out))
            if not more:
                raise ValueError("the data end within a value")
            out += more
        return out

    def _string_length(self) -> int:
        n = shift = 0
        while True:
            b = self._bytes(1)[0]
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    def value(self, kind: Kind):
        k = kind.name
        if k in _ATOMS:
            return struct.unpack(_ATOMS[k], self._bytes(struct.calcsize(_ATOMS[k])))[0]
        readers: dict[str, Callable] = {"none": lambda: None, "character": self._character, "sstring": self._text}
        if k in readers:
            return readers[k]()
        if k == "record":
            return tuple(self.value(t) for _, t in kind.parts)
        if k == "sequence":
            n = self.value(Kind("longinteger"))
            if not 0 <= n < 1 << 31:
                raise ValueError(f"a sequence of {n} elements")
            return [self.value(kind.element) for _ in range(n)]
        if k == "union":
            tag = self._bytes(1)[0]
            if tag >= len(kind.parts):
                raise ValueError("no such variant")
            return (tag, self.value(kind.parts[tag][1]))
        raise ValueError(f"{k} has no binary form")

    def _text(self) -> str:
        return self._bytes(self._string_length()).decode("utf-8", "surrogatepass")

    def _character(self) -> str:
        first = self._bytes(1)
        lead = first[0]
        return (first + self._bytes(0 if lead < 0x80 else 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3)).decode()


def read(data: bytes, kind: Kind):
    return Reader(data).value(kind)
