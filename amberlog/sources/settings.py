"""Settings of a base in XML: the stores that make it up, and what it is attached to."""

from __future__ import annotations

import xml.etree.ElementTree as Xml
from dataclasses import dataclass


@dataclass(frozen=True)
class Store:
    """A folder of record files and documents."""

    name: str
    path: str
    writable: bool


def stores(text: str, element: str = "LoadCassette") -> list[Store]:
    """The stores named in a settings file, in order; those marked yes or true may be written to."""
    out = []
    for e in Xml.fromstring(text).iter(element):
        path = (e.text or "").strip()
        out.append(Store(path.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1], path, e.get("write") in ("yes", "true")))
    return out


def attached(text: str, element: str = "database") -> tuple[str, str] | None:
    """(kind, rest) of the connection that a settings file names, None without one."""
    e = Xml.fromstring(text).find(element)
    kind, colon, rest = (e.get("connectionstring") or "").partition(":") if e is not None else ("", "", "")
    return (kind, rest) if colon else None
