"""Labels: partial dates, ranges of dates, names of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months.
MONTHS = ("янв", "фев", "мар", "апр", "май", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")


def partial_date(date: Column | str, months: tuple[str, ...] | dict[str, str] = MONTHS) -> Column:
    """yyyy[-mm[-dd]] as year, name of month, day; null and empty dates give the empty label.

    months: the twelve names, or names by number for some (the others stay numbers).
    """
    d = F.col(date) if isinstance(date, str) else date
    names = months if isinstance(months, dict) else {f"{i + 1:02d}": m for i, m in enumerate(months)}
    mm = F.when(F.length(d) >= 7, F.substring(d, 6, 2)).otherwise("")
    dd = F.when(F.length(d) >= 10, F.substring(d, 9, 2)).otherwise("")
    name = mm if isinstance(months, dict) else F.lit(None)
    for number, label in names.items():
        name = F.when(mm == number, label).otherwise(name)
    tail = F.when(name.isNotNull(), F.concat(name, dd)).otherwise("") if not isinstance(months, dict) else F.concat(name, dd)
    return F.when(d.isNull() | (d == ""), "").otherwise(F.concat(F.when(F.length(d) >= 4, F.substring(d, 1, 4)).otherwise(""), tail))


def date_range(start: Column, end: Column) -> Column:
    """Both labels joined by a dash; without an end the start alone."""
    return F.concat(partial_date(start), F.when(end.isNull() | (end == ""), "").otherwise(F.concat(F.lit("-"), partial_date(end))))


def split_name(iri: Column | str) -> Column:
    """struct(namespace, name) of a full name, cut after the last slash or hash; without one the namespace is empty."""
    c = F.col(iri) if isinstance(iri, str) else iri
    return F.struct(F.regexp_extract(c, r"^(.*[/#])?", 1).alias("namespace"), F.regexp_extract(c, r"([^/#]*)$", 1).alias("name"))
