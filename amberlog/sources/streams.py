"""Files as streams: paths are rows, and each task opens its files itself and reads them piece by piece, whatever their size."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read at once.
PIECE = 1 << 20


def paths(spark: SparkSession, path: str, per_task: int = 1) -> DataFrame:
    """(path): the files under a path or pattern, listed by Spark without reading them, ``per_task`` of them in a task."""
    files = spark.read.format("binaryFile").load(path).select("path")
    n = files.count()
    return files.repartition(max(1, -(-n // per_task)), F.xxhash64("path"))


def opened(path: str):
    """A file of any file system that Arrow knows, opened as a stream."""
    where = path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"
    system, inner = fs.FileSystem.from_uri(where)
    return system.open_input_stream(inner)


def texts(path: str, encoding: str = "utf-8") -> Iterator[str]:
    """The text of a file in pieces."""
    import codecs

    decode = codecs.getincrementaldecoder(encoding)().decode
    with opened(path) as stream:
        while piece := stream.read(PIECE):
            yield decode(piece)
        yield decode(b"", True)
