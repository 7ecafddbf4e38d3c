"""Entries of list-valued columns, read with only the fields that are used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def narrowed(array: str, *fields: str) -> Column:
    """A list of structs with just these fields.

    Exploding the column itself, or a lambda over it, reads every field of its structs; lists of single fields are read alone, and zipping
    them again costs nothing next to that.  A null list stays null, a null entry becomes one of nulls.
    """
    parts = [F.col(f"{array}.{f}") for f in fields]
    return F.arrays_zip(*parts) if len(parts) > 1 else F.transform(parts[0], lambda x: F.struct(x.alias(fields[0])))
