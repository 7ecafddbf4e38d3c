"""Plain Python versions of the general problems, written apart from the operators."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from datetime import date, datetime, timezone

WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0   　"


def key(s):
    return (s or "").replace("|", "").strip(WHITE)


def local(s):
    return re.sub(r"^(\{[^}]*\}|[A-Za-z_][\w.-]*:)", "", (s or "").strip(WHITE)).strip(WHITE)


def change_time(s):
    s = (s or "").strip()
    for f in ("%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y"):
        try:
            return datetime.strptime(s, f).replace(tzinfo=timezone.utc).timestamp()
        except ValueError:
            pass
    try:
        d = datetime.fromisoformat(s.replace("Z", "+00:00"))
    except ValueError:
        return float("-inf")
    return (d if d.tzinfo else d.replace(tzinfo=timezone.utc)).timestamp()


def classes(rows):
    """{name: (root, steps)} from rows (def_seq, about, subclassof)."""
    best = {}
    for seq, about, parent in rows:
        k = key(local(about))
        if k and (k not in best or best[k][0] < seq):
            best[k] = (seq, key(local(parent)))
    up = {k: p for k, (_, p) in best.items() if p in best}
    out = {}
    for k in best:
        seen, c = {}, k
        while c in up and c not in seen:
            seen[c] = len(seen)
            c = up[c]
        out[k] = (min(x for x in seen if seen[x] >= seen[c]), -1) if c in seen else (c, len(seen))
    return out


def state(rows):
    """(winner by key, first defining seq by key) from rows with seq, mt, id, tp."""
    best, first = {}, {}
    for r in rows:
        k = key(r["id"])
        if not k:
            continue
        dead = local(r["tp"]).lower() == "delete"
        order = (change_time(r["mt"]), -r["seq"])
        if k not in best or best[k][0] < order:
            best[k] = (order, r["seq"], dead)
        if not dead:
            first[k] = min(first.get(k, r["seq"]), r["seq"])
    return best, first


def current(rows):
    return sorted((k, seq) for k, (_, seq, dead) in state(rows)[0].items() if not dead)


def orphans(rows):
    best, first = state(rows)
    out = []
    for r in rows:
        if local(r["tp"]).lower() == "delete":
            continue
        for i, p in enumerate(r["props"] or []):
            t = key({2: p["link"], 3: p["sourcelink"]}.get(p["tag"])) if p else ""
            status = "" if not t else "missing" if t not in first else "deleted" if best[t][2] else "late" if first[t] > r["seq"] else ""
            if status:
                out.append((r["seq"], i, status))
    return sorted(out)


def typed(s, kind):
    if kind == "integer":
        ok = re.fullmatch(r"[+-]?\d+", s) or re.fullmatch(r"[+-]?\d{1,3}([    ]\d{3})+", s)
        return int(re.sub(r"\s", "", s)) if ok else None
    if kind == "real":
        return float(s.replace(",", ".")) if re.fullmatch(r"[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?", s) else None
    if kind == "boolean":
        return {"t": True, "true": True, "1": True, "f": False, "false": False, "0": False}.get(s.lower())
    if kind == "date":
        m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d))?)?", s)
        parts = (m[1], m[2] or 1, m[3] or 1) if m else (lambda n: (n[3], n[2], n[1]) if n else None)(re.fullmatch(r"(\d\d)\.(\d\d)\.(\d{4})", s))
        try:
            return date(*map(int, parts)) if parts else None
        except ValueError:
            return None
    return s


def unclean(triples, declared):
    given = defaultdict(list)
    for s, p, o in triples:
        p, o = local(p).lower(), (o or "").strip(WHITE)
        if s is not None and p in declared and o:
            given[s, p].append(o)
    out = []
    for (s, p), values in given.items():
        fit = {v for v in (typed(o, declared[p][0]) for o in values) if v is not None}
        if not fit or declared[p][1] and len(fit) > 1:
            out.append((s, p, "conflict" if fit else "untyped"))
    return sorted(out)


def entries(bodies):
    out = []

    def number(x):
        try:
            return int(x)
        except (TypeError, ValueError):
            return None

    def refuse(_):
        raise ValueError

    def some(x, raw, path):
        if isinstance(x, str):
            try:
                x = json.loads(x, parse_constant=refuse)
            except ValueError:
                return
        for i, r in enumerate(x if isinstance(x, list) else [x]):
            if isinstance(r, dict):
                props = r.get("props")
                for j, e in enumerate(props if isinstance(props, list) else [] if props is None else [props]):
                    entry(e, raw, [*path, i, j], r.get("id") or "")

    def entry(e, raw, path, holder):
        tag = content = None
        if isinstance(e, list) and len(e) == 2:
            tag, content = number(e[0]), e[1]
        elif isinstance(e, dict) and "tag" in e:
            tag, content = number(e["tag"]), {k: v for k, v in e.items() if k != "tag"}
        elif isinstance(e, dict):
            tag, content = next(((t, e[n]) for n, t in (("field", 1), ("objprop", 2), ("invlink", 3)) if n in e), (None, None))
        if tag in (1, 2, 3) and content:
            out.append((raw, ".".join(map(str, path)), {1: "field", 2: "objprop", 3: "invlink"}[tag], holder))
            if tag > 1 and content.get("record") is not None:
                some(content["record"], raw, path)

    for raw, body in bodies:
        try:
            top = json.loads(body, parse_constant=refuse)
        except (TypeError, ValueError):
            continue
        if isinstance(top, (dict, list)):
            some(top, raw, [])
    return sorted(out)
