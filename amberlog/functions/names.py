"""Reading rules for ids, links and names, as column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outer white space in the Unicode sense, with the separators U+001C to U+001F.
_OUTER = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: A namespace in braces or a short prefix with a colon, at the start of a name.
_QUALIFIER = r"^(?:\{[^}]*\}|[A-Za-z_][A-Za-z0-9_.-]*:)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without outer white space of any kind; null stays null."""
    return F.regexp_replace(_col(c), _OUTER, "")


def key_of(c: Column | str) -> Column:
    """The key of an id or link: every bar and all outer white space dropped, case kept; null gives the empty key."""
    return F.coalesce(trimmed(F.regexp_replace(_col(c), r"\|", "")), F.lit(""))


def local_name(c: Column | str) -> Column:
    """Without outer white space and without namespace or short prefix, case kept; null gives the empty name."""
    return F.coalesce(trimmed(F.regexp_replace(trimmed(c), _QUALIFIER, "")), F.lit(""))


def local_lower(c: Column | str) -> Column:
    """Local name for case-insensitive comparison (types, properties, predicates)."""
    return F.lower(local_name(c))


def class_key(c: Column | str) -> Column:
    """Key of the local name of a class."""
    return key_of(local_name(c))


def is_delete(tp: Column | str) -> Column:
    """Whether a row of this type deletes its record."""
    return local_lower(tp) == "delete"
