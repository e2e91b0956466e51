"""Plain-text files as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text

_THAI = [*range(0xA1, 0xDB), *range(0xDF, 0xFC)]
_CP874 = {b: bytes([b]).decode("cp874") for b in (0x80, 0x85, *range(0x91, 0x98))}
#: Bytes of neither Thai set; a mark that follows no Thai letter; and two Thai letters in a row.
_NOT_THAI, _LOOSE_MARK, _THAI_RUN = r"[\u00DB-\u00DE\u00FC-\u00FF]", r"(^|[^\u00A1-\u00FB])[\u00D1\u00D4-\u00DA\u00E7-\u00EE]", r"[\u00A1-\u00DA\u00DF-\u00FB]{2}"


def decoded(content: Column, single_byte: str = "detect") -> Column:
    """Bytes as text: strict UTF-8 (a leading byte order mark is dropped), else a single-byte set: ``thai`` is CP874, or
    ISO-8859-11 where CP874 lacks a byte; ``latin`` is ISO-8859-1; ``detect`` takes Thai where all bytes are Thai ones, marks
    follow Thai letters and two of those stand together, else Latin."""
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^\ufeff", ""))
    latin = F.decode(content, "ISO-8859-1")
    letters = F.translate(latin, "".join(map(chr, _THAI)), "".join(chr(0x0E01 + b - 0xA1) for b in _THAI))
    marks = F.translate(letters, "".join(map(chr, _CP874)), "".join(_CP874.values()))
    thai = F.when(F.rlike(latin, F.lit(r"[\u0081-\u0084\u0086-\u0090\u0098-\u009F]")), letters).otherwise(marks)
    has = lambda pattern: F.rlike(latin, F.lit(pattern))
    found = F.when(has(_THAI_RUN) & ~has(_NOT_THAI) & ~has(_LOOSE_MARK), thai).otherwise(latin)
    return F.coalesce(utf8, {"detect": found, "thai": thai, "latin": latin}[single_byte])


def read_text(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = True, limit: int | None = None) -> DataFrame:
    """``doc_id, filename, filepath, relative_path, document_type, text, size_bytes`` of cleaned files. The type is the folder below
    ``folder``; ids follow the relative path, so they are stable. A missing folder is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    root = folder.rstrip("/").removeprefix("file:")
    rel = F.substr("path", F.locate(root + "/", F.col("path")) + F.lit(len(root) + 1))
    out = files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("path").alias("filepath"), rel.alias("relative_path"),
        F.regexp_extract(rel, r"^(.*)/[^/]+$", 1).alias("document_type"), clean_text(decoded(F.col("content"))).alias("text"), F.col("length").alias("size_bytes"),
    ).withColumn("doc_id", F.sha2("relative_path", 256))
    return out.orderBy("relative_path").limit(limit) if limit is not None else out
