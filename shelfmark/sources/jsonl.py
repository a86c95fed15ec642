"""JSON-lines dumps as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import strip


def arrival(release_rank: int, file: Column, block: Column) -> Column:
    """The place of a line in the order of arrival: release, file by name, place in the file.

    Spark deals pieces of files to tasks by size, but reads each piece in order; so the start of the piece and the row
    within the task order the lines of a file, however it is cut.
    """
    return F.struct(
        F.lit(release_rank).cast("long").alias("release"),
        file.alias("file"),
        block.cast("long").alias("block"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"),
    )


def _numbered(df: DataFrame, release_rank: int) -> DataFrame:
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return df.select(
        arrival(release_rank, file, block).alias("seq"), strip(F.col("value")).alias("line"), file.alias("file")
    ).filter(F.length("line") > 0)


def read_lines(
    spark: SparkSession, path: str | list[str], release_rank: int = 1, tolerant: bool = False
) -> DataFrame:
    """Non-empty trimmed lines with their place ``seq`` in the order of arrival.

    Releases are ranked in arrival order; rows of a later release come after all rows of an earlier one. ``tolerant`` (S3) reads what is readable and skips damaged or missing files.
    """
    reader = spark.read
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return _numbered(reader.text(path), release_rank)


def read_line_stream(
    spark: SparkSession, path: str, release_rank: int = 1, max_files: int = 100
) -> DataFrame:
    """Payload files as they arrive, a bounded number per micro-batch."""
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    return stream.select(
        F.lit(release_rank).alias("release_rank"),
        strip(F.col("value")).alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    ).filter(F.length("line") > 0)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path, their content unread."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))


def unread_files(listing: DataFrame, lines: DataFrame) -> DataFrame:
    """S3: files of a listing (column ``file``) from which no line could be read."""
    return listing.join(lines.select("file").distinct(), "file", "left_anti")


def parse_lines(lines: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """The line as struct ``raw``; ``bad`` is the line itself when it does not fit the schema."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    raw = F.from_json(F.col(column), f"{schema[:-1]}, _bad:string>", options)
    return lines.withColumn("raw", raw).withColumn("bad", F.col("raw._bad"))


def error_text(kind: Column, message: Column, line: Column) -> Column:
    """What is kept of a failed line."""
    return F.concat(kind, F.lit(": "), message, F.lit(" :: "), F.substring(line, 1, 200))
