"""A folder of files as a stream of records: every file once, however often the stream is started anew."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.packages import Record, records

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, reader: Callable[[bytes], Iterator[Record]], at_once: int = 1000) -> DataFrame:
    """The records of the files that come into a folder, at most so many files a batch; a file that is refused is an error record."""
    return records(spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", at_once).load(folder), reader)
