"""Uploads as bytes: magic numbers, XML guards, PDF facts, and the entries of ZIP archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of an upload.
MAX_BYTES = 20 * 2**20
MAX_ENTRIES = 50
MAX_UNZIPPED = 100 * 2**20
MAX_XML = 2**20
MAX_TAGS = 5000
_MAGIC = (("25504446", "pdf"), ("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("504B0304", "zip"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files, larger ones cut off by the pushed-down length filter."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_BYTES)


def sniffed(content: Column) -> Column:
    """The format of bytes: by magic number, else by the first character after a mark and white space."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.regexp_replace(F.decode(content, "UTF-8"), "^[﻿ \t\n\r]+", "")
    out = F.when(text.startswith("<"), "xml").when(text.startswith("{") | text.startswith("["), "json").otherwise("unknown")
    for magic, name in reversed(_MAGIC):
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def inspected(blobs: DataFrame, content: str = "content") -> DataFrame:
    """Adds format, sha256, n_bytes, n_tags, has_dtd, n_pages, encrypted and status (accepted, quarantined, rejected)."""
    c = F.col(content)
    latin = F.decode(c, "ISO-8859-1")
    out = blobs.withColumns({
        "format": sniffed(c), "sha256": F.sha2(c, 256), "n_bytes": F.octet_length(c).cast("bigint"),
        "n_tags": F.regexp_count(latin, F.lit("<[A-Za-z/!?]")), "has_dtd": latin.rlike("(?i)<!(DOCTYPE|ENTITY)"),
        "n_pages": F.greatest(F.lit(1), F.regexp_count(latin, F.lit(r"/Type\s*/Page\b"))), "encrypted": latin.contains("/Encrypt"),
    })
    bad_xml = (F.col("format") == "xml") & ((F.col("n_bytes") > MAX_XML) | F.col("has_dtd") | (F.col("n_tags") > MAX_TAGS))
    bad_pdf = (F.col("format") == "pdf") & (F.col("encrypted") | ~latin.contains("%%EOF"))
    return out.withColumn("status", F.when((F.col("n_bytes") > MAX_BYTES) | (F.col("n_bytes") == 0), "rejected").when(bad_xml | bad_pdf | (F.col("format") == "unknown"), "quarantined").otherwise("accepted"))


def unsafe_name(name: str) -> bool:
    return name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or "\0" in name or ":" in name


def archive_entries(archives: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, entry, position, content, issue) of every file of each ZIP; an archive over a limit gives one row with its issue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, data in zip(batch["key"], batch["content"], strict=True):
                yield pd.DataFrame(list(_entries(k, data)), columns=["key", "entry", "position", "content", "issue"])

    return archives.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).mapInPandas(run, "key string, entry string, position int, content binary, issue string")


def _entries(key: str, data: bytes | None) -> Iterator[tuple]:
    if not data or len(data) > MAX_BYTES:
        yield key, None, 0, None, "archive_size"
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        infos = [i for i in archive.infolist() if not i.is_dir() and "__MACOSX" not in i.filename and not i.filename.endswith(".DS_Store")]
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        yield key, None, 0, None, "not_an_archive"
        return
    if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_UNZIPPED:
        yield key, None, 0, None, "archive_limits"
        return
    for at, info in enumerate(infos, 1):
        if unsafe_name(info.filename) or info.file_size > MAX_BYTES:
            yield key, info.filename, at, None, "unsafe_entry"
            continue
        try:
            yield key, info.filename, at, archive.read(info), None
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError):
            yield key, info.filename, at, None, "unreadable_entry"
