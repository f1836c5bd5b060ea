"""PNG headers and batches of expected media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.contracts import findings

# Fixed bytes: the PNG signature.
PNG_MAGIC = "89504E470D0A1A0A"
HEADER_BYTES = 24
MIN_BYTES = 60_000


def is_png(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 8)) == PNG_MAGIC


def _big_endian(content: Column, offset: int) -> Column:
    return F.conv(F.hex(F.substring(content, offset + 1, 4)), 16, 10).cast("bigint")


def png_sizes(files: DataFrame, content: str = "content") -> DataFrame:
    """Width and height from the header; NULL when it is not a whole PNG header."""
    data = F.col(content)
    whole = is_png(data) & (F.octet_length(data) >= HEADER_BYTES)
    return files.withColumns(
        {
            "width": F.when(whole, _big_endian(data, 16)),
            "height": F.when(whole, _big_endian(data, 20)),
        }
    )


def image_findings(
    files: DataFrame, min_bytes: int, min_width: int = 0, min_height: int = 0
) -> DataFrame:
    sized = png_sizes(files)
    return findings(
        sized, ["path"],
        [
            ("too-small", F.octet_length("content") < min_bytes),
            ("not-png", F.col("width").isNull()),
            ("too-narrow", F.col("width") < min_width), ("too-low", F.col("height") < min_height),
        ],
    )


def batch_findings(expected: DataFrame, files: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Expected files that are missing, too small or no PNG; only headers are shuffled."""
    heads = files.select(
        "path", F.octet_length("content").cast("bigint").alias("_n"), is_png(F.col("content")).alias("_png")
    )
    joined = expected.join(heads, "path", "left")
    gone = F.col("_n").isNull()
    return findings(
        joined, ["path"],
        [("missing", gone), ("too-small", F.col("_n") < min_bytes), ("not-png", ~gone & ~F.col("_png"))],
    )
