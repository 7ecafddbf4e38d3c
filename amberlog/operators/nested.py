"""Deeply nested records to flat tables of records and entries.

A depth-first walk over each body gives every node an interval: its number on the way in (``pre``) and on the way out (``post``).  A node
lies inside another exactly if its interval does, so the flat tables are linked by interval containment, without ids of parents: an entry
belongs to the innermost record whose interval holds it.  Bodies are walked one by one in Arrow batches (an explicit stack, no recursion,
so depth is not bounded); nothing is grouped beyond one body.

A record has optional ``id``, ``tp``, ``mT``, ``props``.  An entry of ``props`` is a field, objprop or invlink, named by its variant, with a
``tag``, or as a pair of tag and content.  ``record`` of an objprop or invlink holds a record, a list of records, or either as JSON text.

Defined results.  A body that is null, blank or not valid JSON as a whole gives no rows (constants like NaN and half surrogates in numbers are
not JSON), and so does a body that is neither record nor list.  Whole numbers of any length are numbers; a number beyond the range of reals is
one too.  Of an entry with several variants the first that is filled counts (field, objprop, invlink).  List items that are no records keep their position and give no rows; so do
null, empty and tag-0 entries.  A lone entry in place of a list has position 0.  A record text that is not JSON holds nothing.  Other keys are
ignored.  Of a repeated key the last counts.  Repeated bodies are walked each for itself.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The variants of an entry by tag.
KINDS = {1: "field", 2: "objprop", 3: "invlink"}
_TAGS = {k: t for t, k in KINDS.items()}
NODES = "raw_id bigint, node string, pre int, post int, level int, at string, kind string, id string, tp string, mt string, prop string, value string, lang string, target string"
_TEXT = [f.split()[0] for f in NODES.split(", ")][5:]


def _no(constant: str):
    raise ValueError(constant)


class Digits(str):
    """A whole number of any length, kept as its text: reading it as a number takes time that grows with the square of its length."""


def _whole(text: str) -> int | Digits:
    return int(text) if len(text) < 1_000 else Digits(text)


def parse(text: str | None):
    """The value of a JSON text; raises ValueError if it is none.  Texts nested too deeply for the recursive parser go to one with a stack."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_constant=_no, parse_int=_whole)
    except RecursionError:
        return _parse_deep(text)


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _parse_deep(text: str):
    """JSON without recursion: open containers lie on a stack, each with the key that waits for a value."""
    done: list = []
    stack: list[tuple] = [(done, None)]
    at = _BLANK.match(text, 0).end()

    def put(v) -> None:
        box, k = stack[-1]
        if k is None:
            box.append(v)
        else:
            box[k] = v

    def key_from(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(f"a key is missing at {i}")
        k, i = scanstring(text, i + 1)
        i = _BLANK.match(text, i).end()
        if text[i : i + 1] != ":":
            raise ValueError(f"a colon is missing at {i}")
        return k, _BLANK.match(text, i + 1).end()

    while True:
        c = text[at : at + 1]
        opened = None
        if c == '"':
            v, at = scanstring(text, at + 1)
        elif c in _WORDS and text.startswith(_WORDS[c][0], at):
            v, at = _WORDS[c][1], at + len(_WORDS[c][0])
        elif c and c in "[{":
            v = opened = [] if c == "[" else {}
            at = _BLANK.match(text, at + 1).end()
        elif m := _NUMBER.match(text, at):
            v, at = (float(m[0]) if m[1] or m[2] else _whole(m[0])), m.end()
        else:
            raise ValueError(f"no value at {at}")
        put(v)
        if opened is not None and text[at : at + 1] != ("]" if c == "[" else "}"):
            k = None
            if c == "{":
                k, at = key_from(at)
            stack.append((opened, k))
            continue
        if opened is not None:
            at += 1
        while True:  # after a value: close containers, or go on to the next value of the innermost
            at = _BLANK.match(text, at).end()
            if len(stack) == 1:
                if at != len(text):
                    raise ValueError(f"more text at {at}")
                return done[0]
            box, k = stack[-1]
            c = text[at : at + 1]
            if c == ("]" if k is None else "}"):
                stack.pop()
                at += 1
            elif c == ",":
                at = _BLANK.match(text, at + 1).end()
                if k is not None:
                    k, at = key_from(at)
                    stack[-1] = (box, k)
                break
            else:
                raise ValueError(f"a comma is missing at {at}")


_TAG = re.compile(r"\s*\+?[0-9]{1,9}\s*")


def _tag(x) -> int | None:
    if isinstance(x, (bool, Digits)) or x is None:
        return None
    if isinstance(x, int):
        return x
    if isinstance(x, float):
        return int(x) if math.isfinite(x) and x == int(x) else None
    if isinstance(x, str):
        return int(x) if _TAG.fullmatch(x) else _TAGS.get(x.strip().lower())
    return None


def _entry(e) -> tuple[str, dict] | None:
    """(kind, content) of an entry, None for empty and tag-0 entries."""
    if isinstance(e, list):
        kind = KINDS.get(_tag(e[0])) if e else None
        return (kind, e[1]) if kind and len(e) > 1 and isinstance(e[1], dict) and e[1] else None
    if not isinstance(e, dict):
        return None
    if "tag" in e:
        kind = KINDS.get(_tag(e["tag"]))
        return (kind, e) if kind and len(e) > 1 else None
    return next(((kind, e[kind]) for kind in _TAGS if isinstance(e.get(kind), dict) and e[kind]), None)


def _props(props) -> list:
    if isinstance(props, list):
        lone_pair = len(props) == 2 and not isinstance(props[0], (dict, list)) and _tag(props[0]) is not None and isinstance(props[1], (dict, type(None)))
        return [props] if lone_pair else props
    return [] if props is None else [props]


_NO_MORE = object()


def _text(x) -> str:
    """A JSON value as text, without recursion: what is still to be written lies on a stack."""
    out: list[str] = []
    stack: list = [iter([("", x)])]
    closing: list[str] = [""]
    while stack:
        item = next(stack[-1], _NO_MORE)
        if item is _NO_MORE:
            stack.pop()
            out.append(closing.pop())
            continue
        lead, v = item
        out.append(lead)
        if isinstance(v, dict):
            out.append("{")
            closing.append("}")
            stack.append(iter([((", " if i else "") + json.dumps(k, ensure_ascii=False) + ": ", w) for i, (k, w) in enumerate(v.items())]))
        elif isinstance(v, list):
            out.append("[")
            closing.append("]")
            stack.append(iter([(", " if i else "", w) for i, w in enumerate(v)]))
        else:
            out.append(str(v) if isinstance(v, Digits) else json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _str(x) -> str | None:
    return str(x) if isinstance(x, str) else None if x is None else _text(x)


def walk(body: str | None) -> list[dict]:
    """The nodes of one body in order of ``pre``."""
    try:
        top = parse(body)
    except ValueError:
        return []
    nodes: list[dict] = []
    clock = 0
    # a task opens a value ('records', 'record', 'entry') or closes a node (its index)
    stack: list = [("records", top, "", 0)]
    while stack:
        what = stack.pop()
        if isinstance(what, int):
            nodes[what]["post"] = clock
            clock += 1
            continue
        kind, x, path, level = what
        if kind == "records":
            if isinstance(x, str) and level and not isinstance(x, Digits):
                try:
                    x = parse(x)
                except ValueError:
                    continue
                if isinstance(x, str):
                    continue
            items = x if isinstance(x, list) else [x]
            stack += [("record", r, f"{path}{i}", level) for i, r in reversed(list(enumerate(items))) if isinstance(r, dict)]
            continue
        node = {"pre": clock, "level": level, "at": path}
        clock += 1
        if kind == "record":
            node |= {"node": "record", "id": _str(x.get("id")), "tp": _str(x.get("tp")), "mt": _str(x.get("mT"))}
            inner = [("entry", e, f"{path}.{i}", level + 1) for i, e in enumerate(_props(x.get("props"))) if _entry(e)]
        else:
            name, c = _entry(x)
            node |= {"node": "entry", "kind": name, "prop": _str(c.get("prop")), "value": _str(c.get("value")), "lang": _str(c.get("lang"))}
            node["target"] = _str(c.get({"objprop": "link", "invlink": "sourcelink"}.get(name, "")))
            inner = [("records", c["record"], f"{path}.", level + 1)] if name != "field" and c.get("record") is not None else []
        stack.append(len(nodes))
        nodes.append(node)
        stack += reversed(inner)
    return nodes


def _clean(s: str | None) -> str | None:
    """Half surrogates (legal in JSON escapes) cannot be stored as UTF-8; they become U+FFFD."""
    return s if s is None or s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64() if n == "raw_id" else pa.int32() if n in ("pre", "post", "level") else pa.string()) for n in (f.split()[0] for f in NODES.split(", "))])
    for b in batches:
        out: dict[str, list] = {n: [] for n in schema.names}

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
            for x in out.values():
                x.clear()
            return done

        for raw, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for n in walk(body):
                out["raw_id"].append(raw)
                out["node"].append(n["node"])
                for c in ("pre", "post", "level"):
                    out[c].append(n[c])
                for c in _TEXT:
                    out[c].append(_clean(n.get(c)))
            if len(out["pre"]) > 20_000:
                yield flush()
        yield flush()


def label_nodes(bodies: DataFrame, raw_id: str = "raw_id", body: str = "body") -> DataFrame:
    """Every record and entry of every body with its interval; columns as in NODES."""
    return bodies.select(F.col(raw_id).cast("bigint"), body).mapInArrow(_label, NODES)


def records(nodes: DataFrame) -> DataFrame:
    """(raw_id, pre, post, level, record_path, id, tp, mt): the flat table of records."""
    return nodes.where("node = 'record'").select("raw_id", "pre", "post", "level", F.col("at").alias("record_path"), "id", "tp", "mt")


def entries(nodes: DataFrame) -> DataFrame:
    """(raw_id, pre, post, level, entry_path, kind, prop, value, lang, target): the flat table of entries."""
    return nodes.where("node = 'entry'").select("raw_id", "pre", "post", "level", F.col("at").alias("entry_path"), "kind", "prop", "value", "lang", "target")


def held(nodes: DataFrame) -> DataFrame:
    """The entries with ``holder_id`` and ``holder_path`` of the record directly around: the one a level up whose interval contains theirs.

    Records and the entries directly in them share a partition of the window, in which the last record that opened before an entry is the only
    one that can contain it; the intervals are compared all the same.  One shuffle by body, no join, one walk over the bodies.
    """
    w = Window.partitionBy("raw_id", F.floor(F.col("level") / 2)).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("node") == "record", F.struct("pre", "post", "id", "at")), ignorenulls=True).over(w)
    x = nodes.withColumn("around", opened).where("node = 'entry' and around.pre < pre and post < around.post")
    flat = entries(x.withColumn("node", F.lit("entry"))).columns
    return x.withColumnRenamed("at", "entry_path").select(*flat, F.col("around.id").alias("holder_id"), F.col("around.at").alias("holder_path"))
