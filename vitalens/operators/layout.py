"""Page layout signals from extraction output: columns, scans, table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
MIN_PAGE_WORDS = 40
GUTTER_SHARE = 0.06
MIN_SIDE_SHARE = 0.22
MAX_STRADDLE_SHARE = 0.12
MIN_CHARS_PER_PAGE = 200


def two_column_pages(words: DataFrame) -> DataFrame:
    """(doc_id, page, n_words, two_column) from word boxes (doc_id, page, x0, x1, page_width).

    Only counters are aggregated, so boxes are combined before the shuffle.
    """
    mid, half = F.col("page_width") / 2, F.col("page_width") * GUTTER_SHARE
    left = F.col("x1") < mid - half
    right = ~left & (F.col("x0") > mid + half)
    counts = words.groupBy("doc_id", "page").agg(
        F.count("*").alias("n_words"),
        F.count_if(left).alias("n_left"),
        F.count_if(right).alias("n_right"),
        F.max("page_width").alias("width"),
    )
    n = F.col("n_words")
    straddling = n - F.col("n_left") - F.col("n_right")
    flag = (
        (n >= MIN_PAGE_WORDS)
        & (F.col("width") > 0)
        & (F.least("n_left", "n_right") / n > MIN_SIDE_SHARE)
        & (straddling / n < MAX_STRADDLE_SHARE)
    )
    return counts.select("doc_id", "page", "n_words", flag.alias("two_column"))


def multi_column_counts(words: DataFrame) -> DataFrame:
    """(doc_id, multi_column_pages)"""
    return (
        two_column_pages(words)
        .groupBy("doc_id")
        .agg(F.count_if("two_column").alias("multi_column_pages"))
    )


def is_scanned(text: Column, pages: Column) -> Column:
    """Almost no selectable text for the number of pages."""
    return (pages > 0) & (F.length(text) < MIN_CHARS_PER_PAGE * pages)


def table_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, line): cells joined by " | ".

    Empty cells are skipped and a cell equal to the one before it is a merged
    cell repeating its text.  Rows without any text disappear.
    """
    row = ["doc_id", "table_no", "row_no"]
    filled = cells.filter(F.col("cell") != "")
    before = F.lag("cell").over(Window.partitionBy(*row).orderBy("col_no"))
    kept = filled.withColumn("before", before).filter(
        F.col("before").isNull() | (F.col("before") != F.col("cell"))
    )
    return kept.groupBy(*row).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda x: x["cell"]
            ),
            " | ",
        ).alias("line")
    )
