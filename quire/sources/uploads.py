"""Uploaded files as rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def scan_uploads(
    spark: SparkSession, path: str, stream: bool = False, with_content: bool = False, pattern: str | None = None
) -> DataFrame:
    """Files below ``path``: path, filename, extension, size, modified [, content].

    Without ``with_content`` no file is opened; only the listing is used. Further folders below ``path``
    are included; Spark's reader leaves out empty files. ``stream`` gives a stream of newly arriving files.
    """
    reader = spark.readStream.schema(_BINARY_FILE) if stream else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    name = F.substring_index("path", "/", -1)
    extension = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    columns = [
        F.col("path"),
        name.alias("filename"),
        extension.alias("extension"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ]
    return reader.load(path).select(*columns, *(["content"] if with_content else []))
