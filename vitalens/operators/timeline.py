"""Employment timeline: month ordinals, gaps and tenure."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalens.functions.core import built_once, unnest
from vitalens.operators import facts as fx

MIN_GAP_MONTHS = 6


def month_ordinal(day: date) -> int:
    return day.year * 12 + day.month


def spans(ranges: Column, today: date) -> Column:
    """Spans (start, seq, end) as month ordinals, by start and then document order."""
    now = F.lit(month_ordinal(today))
    return F.array_sort(
        F.transform(
            ranges,
            lambda r, i: F.struct(
                (r["start_year"] * 12 + F.coalesce(r["start_month"], F.lit(1))).alias("start"),
                i.alias("seq"),
                F.when(r["is_current"] | r["end_year"].isNull(), now)
                .otherwise(r["end_year"] * 12 + F.coalesce(r["end_month"], F.lit(12)))
                .alias("end"),
            ),
        )
    )


def gaps(sorted_spans: Column, min_months: int = MIN_GAP_MONTHS) -> Column:
    """Array of (after, before, months): holes between covered time and the next start.

    Ordinals lie within two centuries and every gap spans months no span covers,
    so the array stays short however many spans a document has.
    """
    nothing = F.array().cast("array<struct<after:int,before:int,months:int>>")
    start = F.struct(F.lit(None).cast("int").alias("covered"), nothing.alias("found"))

    def step(acc: Column, s: Column) -> Column:
        months = s["start"] - acc["covered"]
        gap = F.struct(
            acc["covered"].alias("after"), s["start"].alias("before"), months.alias("months")
        )
        return F.struct(
            F.greatest(acc["covered"], s["end"]).alias("covered"),
            F.when(months >= min_months, F.concat(acc["found"], F.array(gap)))
            .otherwise(acc["found"])
            .alias("found"),
        )

    return F.aggregate(sorted_spans, start, step, lambda acc: acc["found"])


def tenure_months(sorted_spans: Column) -> Column:
    """Length of the union of spans; touching and overlapping spans merge."""
    start = F.struct(
        F.lit(None).cast("int").alias("open"),
        F.lit(None).cast("int").alias("until"),
        F.lit(0).alias("total"),
    )

    def closed(acc: Column) -> Column:
        return acc["total"] + F.coalesce(
            F.greatest(F.lit(0), acc["until"] - acc["open"]), F.lit(0)
        )

    def step(acc: Column, s: Column) -> Column:
        joins = s["start"] <= acc["until"]
        return F.struct(
            F.when(joins, acc["open"]).otherwise(s["start"]).alias("open"),
            F.when(joins, F.greatest(acc["until"], s["end"])).otherwise(s["end"]).alias("until"),
            F.when(joins, acc["total"]).otherwise(closed(acc)).alias("total"),
        )

    return F.aggregate(sorted_spans, start, step, closed)


def gap_label(ordinal: Column, legacy: bool = False) -> Column:
    """'YYYY-MM' of a month ordinal.

    ``legacy`` keeps the historic labelling, which reports a December as
    December of the following year.
    """
    shifted = ordinal if legacy else ordinal - 1
    month = (
        F.when(ordinal % 12 == 0, F.lit(12)).otherwise(ordinal % 12)
    )
    return F.concat(
        F.floor(shifted / 12).cast("int").cast("string"),
        F.lit("-"),
        F.lpad(month.cast("string"), 2, "0"),
    )


def expected_pages(months: Column) -> Column:
    return F.when(months >= 144, 3).when(months >= 60, 2).otherwise(1)


# --- long tables ------------------------------------------------------------------------


@built_once
def doc_spans(today: date) -> Column:
    """Work spans of the column ``ranges``."""
    return spans(fx.work_ranges(F.col("ranges")), today)


@built_once
def _doc_gaps(today: date, min_months: int) -> Column:
    return gaps(doc_spans(today), min_months)


@built_once
def _doc_tenure(today: date) -> Column:
    return tenure_months(doc_spans(today))


def spans_table(docs: DataFrame, today: date) -> DataFrame:
    return unnest(fx.parse(docs), ["doc_id"], doc_spans(today))


def gaps_table(
    docs: DataFrame, today: date, min_months: int = MIN_GAP_MONTHS, legacy_gap_labels: bool = False
) -> DataFrame:
    """(doc_id, gap_from, gap_to, months)"""
    return unnest(fx.parse(docs), ["doc_id"], _doc_gaps(today, min_months)).select(
        "doc_id",
        gap_label(F.col("after"), legacy_gap_labels).alias("gap_from"),
        gap_label(F.col("before"), legacy_gap_labels).alias("gap_to"),
        "months",
    )


def tenure(docs: DataFrame, today: date) -> DataFrame:
    """(doc_id, months, years, expected_pages)"""
    return (
        fx.parse(docs)
        .select("doc_id", _doc_tenure(today).alias("months"))
        .select(
            "doc_id",
            "months",
            F.bround(F.col("months") / 12, 1).alias("years"),
            expected_pages(F.col("months")).alias("expected_pages"),
        )
    )
