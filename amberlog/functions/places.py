"""Where the document of a URI lies: store://name@host/path with a ten-character place at its end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders of the size variants.
FOLDERS = {"original": "/originals", "small": "/documents/small", "medium": "/documents/medium", "normal": "/documents/normal"}


def store_name(uri: Column | str) -> Column:
    """The lower-case name before the at sign, null if the URI is of another form."""
    u = F.col(uri) if isinstance(uri, str) else uri
    name = F.lower(F.regexp_extract(u, r"^[a-z]+://([^@]+)@", 1))
    return F.when(name != "", name)


def file_path(uri: Column | str, folder: Column, size: str | None = None) -> Column:
    """The path of a document in the folder of its store; size None is the original, an unknown size the normal variant."""
    u = F.url_decode(F.col(uri) if isinstance(uri, str) else uri)
    sub = FOLDERS["original"] if size is None else FOLDERS.get(size, FOLDERS["normal"])
    return F.when(store_name(u).isNotNull() & (F.length(u) >= 10), F.concat(folder, F.lit(sub), F.substring(u, -10, 10)))
