"""Type descriptors of the record model: what Spark type each becomes, a readable form of values, and types as values.

Values in Python: records are tuples or lists in field order (rows work too), sequences lists, unions (tag, value).  In Spark a union is a struct
with its tag and one nullable field per variant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds in the order of their numbers as values.
KINDS = ("none", "boolean", "character", "integer", "longinteger", "real", "fstring", "sstring", "record", "sequence", "union", "byte")
_SPARK = {"none": T.NullType(), "boolean": T.BooleanType(), "character": T.StringType(), "integer": T.IntegerType(), "longinteger": T.LongType(), "real": T.DoubleType(), "fstring": T.StringType(), "sstring": T.StringType(), "byte": T.ShortType()}


@dataclass(frozen=True)
class Kind:
    """A type: an atom by name, or a record, sequence or union with its parts."""

    name: str
    parts: tuple[tuple[str, Kind], ...] = ()
    size: int = 0
    growing: bool = False

    def __post_init__(self) -> None:
        if self.name not in KINDS:
            raise ValueError(f"no such kind: {self.name}")

    @property
    def element(self) -> Kind:
        return self.parts[0][1]


def record(**parts: Kind) -> Kind:
    return Kind("record", tuple(parts.items()))


def sequence(element: Kind, growing: bool = False) -> Kind:
    return Kind("sequence", (("element", element),), growing=growing)


def union(**parts: Kind) -> Kind:
    return Kind("union", tuple(parts.items()))


NONE, BOOLEAN, CHARACTER, INTEGER, LONG, REAL, STRING, BYTE = (Kind(k) for k in ("none", "boolean", "character", "integer", "longinteger", "real", "sstring", "byte"))


def spark_type(kind: Kind) -> T.DataType:
    if kind.name == "record":
        return T.StructType([T.StructField(n, spark_type(k)) for n, k in kind.parts])
    if kind.name == "sequence":
        return T.ArrayType(spark_type(kind.element), containsNull=False)
    if kind.name == "union":
        return T.StructType([T.StructField("tag", T.IntegerType()), *(T.StructField(n, spark_type(k)) for n, k in kind.parts if k.name != "none")])
    return _SPARK[kind.name]


def to_spark(value, kind: Kind):
    """A plain value in the form that spark_type describes; the null string is empty."""
    if kind.name == "record":
        if len(value) != len(kind.parts):
            raise ValueError("wrong number of fields")
        return tuple(to_spark(v, k) for v, (_, k) in zip(value, kind.parts, strict=True))
    if kind.name == "sequence":
        return [to_spark(v, kind.element) for v in value]
    if kind.name == "union":
        tag, inner = value
        return (tag, *(to_spark(inner, k) if i == tag else None for i, (_, k) in enumerate(kind.parts) if k.name != "none"))
    return "" if value is None and kind.name in ("sstring", "fstring") else value


def from_spark(value, kind: Kind):
    if kind.name == "record":
        return tuple(from_spark(v, k) for v, (_, k) in zip(value, kind.parts, strict=True))
    if kind.name == "sequence":
        return [] if value is None else [from_spark(v, kind.element) for v in value]
    if kind.name == "union":
        tag = value[0]
        places = [i for i, (_, k) in enumerate(kind.parts) if k.name != "none"]
        return (tag, from_spark(value[1 + places.index(tag)], kind.parts[tag][1]) if tag in places else None)
    return value


def real_text(x: float) -> str:
    """The shortest decimal form: plain from 1e-4 up to 1e15, else with E and a signed exponent of two digits at least."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    if digits == (0,):
        return "-0" if sign else "0"
    point = len(digits) + exponent
    s = "".join(map(str, digits))
    if -4 < point <= 15:
        s = s + "0" * exponent if exponent >= 0 else s[:point] + "." + s[point:] if point > 0 else "0." + "0" * -point + s
    else:
        s = s[0] + ("." + s[1:] if len(s) > 1 else "") + f"E{'+' if point > 0 else '-'}{abs(point - 1):02d}"
    return "-" + s if sign else s


def readable(value, kind: Kind, names: bool = False) -> str:
    """The readable form of a value: names of fields at the top only, quotes escaped, unions by the name of the variant."""
    k = kind.name
    if k == "none":
        return ""
    if k == "boolean":
        return "True" if value else "False"
    if k == "character":
        return f"'{value}'"
    if k == "real":
        return real_text(value)
    if k in ("sstring", "fstring"):
        return '"' + (value or "").replace('"', '\\"') + '"'
    if k == "record":
        return "{" + ",".join((f"{n}:" if names else "") + readable(v, t) for v, (n, t) in zip(value, kind.parts, strict=True)) + "}"
    if k == "sequence":
        return "[" + ",".join(readable(v, kind.element) for v in value) + "]"
    if k == "union":
        name, t = kind.parts[_tag(value, kind)]
        return f"{name}^{readable(value[1], t)}"
    return str(value)


def _tag(value: Sequence, kind: Kind) -> int:
    if len(value) != 2 or not 0 <= value[0] < len(kind.parts):
        raise ValueError("no such variant")
    return value[0]


def as_value(kind: Kind, depth: int | None = None):
    """A type as a value: (number of its kind, what belongs to it), to any depth; if ``depth`` is given, types below it are None."""
    if depth is not None and depth < 0:
        return None
    number, below = KINDS.index(kind.name), None if depth is None else depth - 1
    if kind.name == "fstring":
        return (number, kind.size)
    if kind.name in ("record", "union"):
        return (number, [(n, as_value(k, below)) for n, k in kind.parts])
    if kind.name == "sequence":
        return (number, (kind.growing, as_value(kind.element, below)))
    return (number, None)


def from_value(value) -> Kind:
    number, inner = value
    name = KINDS[number]
    if name == "fstring":
        return Kind(name, size=inner)
    if name in ("record", "union"):
        return Kind(name, tuple((n, from_value(v)) for n, v in inner))
    if name == "sequence":
        return Kind(name, (("element", from_value(inner[1])),), growing=inner[0])
    return Kind(name)


def text_column(c: Column, kind: Kind) -> Column:
    """The text form of a column as an expression, for types whose parts the engine can print alike; the null string is empty."""
    k = kind.name
    if k in ("integer", "longinteger", "byte"):
        return c.cast("string")
    if k == "boolean":
        return F.when(c, "t").otherwise("f")
    if k == "character":
        return c
    if k == "sstring":
        return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    if k == "record":
        parts = [x for n, t in kind.parts for x in (F.lit(","), text_column(c[n], t))]
        return F.concat(F.lit("{"), *parts[1:], F.lit("}"))
    if k == "sequence":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda e: text_column(e, kind.element)), ","), F.lit("]"))
    if k == "union":
        out = F.lit(None).cast("string")
        for i, (n, t) in enumerate(kind.parts):
            out = F.when(c["tag"] == i, F.concat(F.lit(f"{i}^"), text_column(c[n], t) if t.name != "none" else F.lit(""))).otherwise(out)
        return out
    raise ValueError(f"{k} has no text expression; use the writer of text_form")
