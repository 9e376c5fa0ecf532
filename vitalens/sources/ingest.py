"""Ingest of document files: accept or reject, decode, clean, describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalens import lexicon as lx
from vitalens.functions import text as tx
from vitalens.functions.core import let

STORED_LAYOUT = T.StructType(
    [
        T.StructField("char_count", T.IntegerType()),
        T.StructField("table_count", T.IntegerType()),
        T.StructField("image_count", T.IntegerType()),
        T.StructField("multi_column_pages", T.IntegerType()),
        T.StructField("has_header_footer_text", T.BooleanType()),
        T.StructField("is_scanned", T.BooleanType()),
        T.StructField("chars_per_page", T.ArrayType(T.IntegerType())),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)

REJECT_REASONS = (
    "too_large", "empty_file", "legacy_format", "unsupported_type", "needs_text_extraction", "almost_no_text",
)

# A UTF-16 text is valid when every high surrogate is followed by a low one.
_UTF16_UNITS_LE = r"^(?:[0-9A-F]{2}(?:[0-9A-CEF][0-9A-F]|D[0-7])|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])*+$"
_UTF16_UNITS_BE = r"^(?:(?:[0-9A-CEF][0-9A-F]|D[0-7])[0-9A-F]{2}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*+$"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files; contents are read where a plan uses them."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def extension(path: Column) -> Column:
    """Lower-case suffix of the file name; names starting with their only dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def codec(content: Column) -> Column:
    """utf-8, else utf-16 (by its byte order mark, little endian without one), else latin-1."""

    def pick(h: Column) -> Column:
        even = F.length(h) % 4 == 0
        return (
            F.when(F.is_valid_utf8(content.cast("string")), "utf-8")
            .when(even & h.startswith("FEFF") & h.rlike(_UTF16_UNITS_BE), "utf-16be")
            .when(even & ~h.startswith("FEFF") & h.rlike(_UTF16_UNITS_LE), "utf-16le")
            .otherwise("latin-1")
        )

    return let(F.hex(content), pick)


def decode(content: Column, name: Column) -> Column:
    """Text of the bytes under a codec; a UTF-16 byte order mark is dropped."""
    utf16 = F.when(name == "utf-16be", F.decode(content, "UTF-16BE")).when(
        name == "utf-16le", F.decode(content, "UTF-16LE")
    )
    return (
        F.when(name == "utf-8", content.cast("string"))
        .when(name == "latin-1", F.decode(content, "ISO-8859-1"))
        .otherwise(F.regexp_replace(utf16, "^﻿", ""))
    )


def screen(files: DataFrame) -> DataFrame:
    """Add ``extension`` and ``reject_reason`` from file facts alone."""
    ext = extension(F.col("path"))
    return files.withColumn("extension", ext).withColumn(
        "reject_reason",
        F.when(F.col("length") > lx.MAX_UPLOAD_BYTES, "too_large")
        .when(F.col("length") == 0, "empty_file")
        .when(F.col("extension") == ".doc", "legacy_format")
        .when(~F.col("extension").isin(*lx.ACCEPTED_EXTENSIONS), "unsupported_type")
        .when(~F.col("extension").isin(*lx.TEXT_EXTENSIONS), "needs_text_extraction"),
    )


def near_empty(text: Column) -> Column:
    return F.length(tx.ustrip(text)) < lx.MIN_TEXT_CHARS


def _description(t: Column) -> dict[str, Column]:
    words = tx.word_count(t)
    return {
        "text_hash": tx.fingerprint(t),
        "layout": F.struct(
            tx.page_estimate(words).alias("page_count"),
            words.alias("word_count"),
            F.length(t).alias("char_count"),
            F.lit(0).alias("table_count"),
            F.lit(0).alias("image_count"),
            F.lit(0).alias("multi_column_pages"),
            F.lit(False).alias("has_header_footer_text"),
            F.lit(False).alias("is_scanned"),
            F.array(F.length(t)).alias("chars_per_page"),
            F.array().cast("array<string>").alias("warnings"),
        ),
    }


def describe(df: DataFrame, text: str = "text") -> DataFrame:
    """Add hash and layout of cleaned plain text."""
    return df.withColumns(_description(F.col(text)))


def mark(files: DataFrame) -> DataFrame:
    """One row per file: path, length, reject_reason (null: accepted), and its document.

    Contents are read in one scan and decoded and cleaned once.  The source takes the filter on
    the length before it opens a file, so files beyond the upload cap are known by their
    listing only.  Bytes of PDF and DOCX files need a codec outside Spark and are reported as
    ``needs_text_extraction``; their extracted text enters through ``clean_documents``.
    """
    small = F.col("length") <= lx.MAX_UPLOAD_BYTES
    facts = ("path", "length", "reject_reason")
    coded = screen(files.filter(small)).withColumn(
        "raw",
        F.when(
            F.col("reject_reason").isNull(),
            let(codec(F.col("content")), lambda c: F.struct(c.alias("codec"), decode(F.col("content"), c).alias("text"))),
        ),
    )

    def document(t: Column) -> Column:
        return F.struct(t.alias("text"), near_empty(t).alias("thin"), *[c.alias(n) for n, c in _description(t).items()])

    # The generator keeps filters on the outcome from being pushed below the parse and repeating it.
    parsed = coded.select(
        *facts,
        "modificationTime",
        F.col("raw.codec").alias("codec"),
        F.explode_outer(F.array(let(tx.clean(F.col("raw.text")), document))).alias("doc"),
    )
    thin = F.when(F.col("doc.thin"), "almost_no_text")
    marked = parsed.select(
        "path",
        "length",
        F.coalesce("reject_reason", thin).alias("reject_reason"),
        F.sha2("path", 256).alias("doc_id"),
        F.regexp_extract("path", "[^/]+$", 0).alias("filename"),
        F.col("modificationTime").alias("created_at"),
        "codec",
        *[F.col(f"doc.{n}").alias(n) for n in ("text", "text_hash", "layout")],
    )
    large = screen(files.filter(~small)).select(*facts)
    return marked.unionByName(large, allowMissingColumns=True)


def accepted_of(marked: DataFrame) -> DataFrame:
    """The documents among marked files."""
    return marked.filter(F.col("reject_reason").isNull()).drop("path", "length", "reject_reason")


def rejected_of(marked: DataFrame) -> DataFrame:
    """(path, length, reject_reason)"""
    return marked.filter(F.col("reject_reason").isNotNull()).select("path", "length", "reject_reason")


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected), each a plan of its own; ``sinks.write_uploads`` stores both in one pass."""
    marked = mark(files)
    return accepted_of(marked), rejected_of(marked)


def drop_near_empty(docs: DataFrame, text: Column) -> DataFrame:
    """Set ``text`` and keep documents with enough of it.

    The text passes through a generator: a plain filter would be pushed below
    the cleaning and clean every document a second time.
    """
    kept = F.filter(F.array(text), lambda t: ~near_empty(t))
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, F.explode_outer(kept).alias("text")).filter(
        F.col("text").isNotNull()
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """Clean extracted text and drop documents left with almost none."""
    return describe(drop_near_empty(docs, tx.clean(F.col("text"))))


def stored_layout(df: DataFrame, column: str) -> DataFrame:
    """Fields of a stored JSON description, each with its default; unknown JSON gives defaults."""
    meta = df.withColumn("_meta", F.from_json(column, STORED_LAYOUT))
    field = lambda n, default: F.coalesce(F.col(f"_meta.{n}"), default).alias(n)
    char_default = F.length("text") if "text" in df.columns else F.lit(0)
    return meta.select(
        *df.columns,
        field("char_count", char_default),
        field("table_count", F.lit(0)),
        field("image_count", F.lit(0)),
        field("multi_column_pages", F.lit(0)),
        field("has_header_footer_text", F.lit(False)),
        field("is_scanned", F.lit(False)),
        field("chars_per_page", F.array().cast("array<int>")),
        field("warnings", F.array().cast("array<string>")),
    )


def repeated_uploads(docs: DataFrame) -> DataFrame:
    """(text_hash, n, first_doc) of texts stored more than once."""
    hashed = docs.select("doc_id", tx.fingerprint(F.col("text")).alias("text_hash"))
    counts = hashed.groupBy("text_hash").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc")
    )
    return counts.filter(F.col("n") > 1)
