"""Images as base64 with their type told from the first bytes; the bytes stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("image/jpg", "image/jpeg", "image/png", "image/webp")


def mime_of(content: Column) -> Column:
    """From magic numbers; null for other formats."""
    head = lambda a, n: F.hex(F.substring(content, a, n))
    return (
        F.when(head(1, 3) == "FFD8FF", "image/jpeg")
        .when(head(1, 8) == "89504E470D0A1A0A", "image/png")
        .when((head(1, 4) == "52494646") & (head(9, 4) == "57454250"), "image/webp")
    )


def mime_of_name(path: Column) -> Column:
    """From the file's ending; PNG for unknown ones."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin("jpg", "jpeg"), "image/jpeg").when(end == "webp", "image/webp").otherwise("image/png")


def read(spark, path: str) -> DataFrame:
    """(path, mime_type, base64) of the image files below a path; unreadable formats are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return encoded(files).where("mime_type IS NOT NULL")


def encoded(files: DataFrame) -> DataFrame:
    return files.select("path", mime_of(F.col("content")).alias("mime_type"), F.base64("content").alias("base64"))


def distinct_images(images: DataFrame) -> DataFrame:
    """Of a document's equal images the first stays."""
    first = images.groupBy("doc_id", "base64").agg(F.min("img_idx").alias("img_idx"))
    return images.join(first, ["doc_id", "base64", "img_idx"], "left_semi").select(images.columns)
