"""End-to-end scoring of a corpus.

Without postings the whole job is one narrow projection over the documents: no
exchange, so skew between documents or copies cannot form a hot task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalens.functions.core import add_sound, built_once, is_sound, let_struct, unnest
from vitalens.operators import features as ft
from vitalens.operators import ordered
from vitalens.operators import rules as ru
from vitalens.operators import scoring as sc


@built_once
def snapshot() -> Column:
    """What was understood of a document, for audit."""
    return let_struct(
        lambda v: F.struct(
            F.array_sort(v["structure"]["recognised"]).alias("detected_sections"),
            F.transform(
                F.filter(v["secs"], lambda s: (s["name"] != "unknown") | (s["word_count"] > 0)),
                lambda s: F.struct(
                    s["name"].alias("name"),
                    s["heading"].alias("heading"),
                    s["word_count"].alias("word_count"),
                ),
            ).alias("sections"),
            F.size(v["bullet_lines"]).alias("bullet_count"),
            F.size(v["ranges"]).alias("range_count"),
            F.size(v["timeline"]["gaps"]).alias("gap_count"),
            v["timeline"]["months"].alias("experience_months"),
            F.bround(v["timeline"]["months"] / 12, 1).alias("experience_years"),
            v["sized"]["word_count"].alias("word_count"),
            v["sized"]["page_count"].alias("page_count"),
        ),
        **{n: F.col(n) for n in ("secs", "structure", "timeline", "sized", "bullet_lines", "ranges")},
    )


@built_once
def _section_order() -> Column:
    """Section names in document order, the header included, unnamed ones not."""
    return F.array_distinct(
        F.transform(F.filter("secs", lambda s: s["name"] != "unknown"), lambda s: s["name"])
    )


def review_documents(
    docs: DataFrame, today: date, catalogue: ru.Catalogue | None = None, guarded: bool = False
) -> DataFrame:
    """Documents with findings, rule_errors, snapshot and has_skills; text and parse stay behind.

    ``ats_findings``, ``structure_findings`` and so on hold the findings of one category, not attributed
    to sections: who reads only these has the other rules pruned.

    A document without text (null) fails: all of these are null.  With ``guarded`` so does one
    whose evaluation raises an error, which else ends the job; every step is evaluated twice then.
    """
    add = add_sound if guarded else DataFrame.withColumns
    ready = docs.withColumn("_sound", F.lit(True)) if guarded else docs
    found = ru.document_findings(ft.profile(ready, today, add), catalogue, add)
    keys = [c for c in ("doc_id", "owner_id", "filename", "target_role") if c in docs.columns]
    parts = {
        "findings": F.col("findings"),
        "rule_errors": F.col("rule_errors"),
        "snapshot": snapshot(),
        "has_skills": F.col("structure")["has_skills"],
        "verb_hint": F.col("impact")["verb_hint"],
        "section_order": _section_order(),
    }
    usable = F.col("text").isNotNull()
    if guarded:
        usable = usable & F.col("_sound") & is_sound(F.struct(*[c.alias(n) for n, c in parts.items()]))
    by_category = {n: F.col(n) for n in found.columns if n.endswith("_findings")}
    return found.select(*keys, *[F.when(usable, c).alias(n) for n, c in (parts | by_category).items()])


def score_corpus(
    docs: DataFrame,
    today: date,
    matches: DataFrame | None = None,
    requests: DataFrame | None = None,
    catalogue: ru.Catalogue | None = None,
    guarded: bool = False,
) -> DataFrame:
    """Reviews: one row per document, or per (doc_id, posting_id) when ``matches`` is given.

    ``matches`` holds (doc_id, posting_id, coverage, matched, missing); see
    ``operators.matching.match_report``, and ``requests`` the pairs it was made
    for.  Only compact findings are shuffled to meet it, never text.

    A document that cannot be reviewed (see ``review_documents``) has null findings, scores and
    band; ``sinks.write_reviews`` stores it as failed.
    """
    reviewed = review_documents(docs, today, catalogue, guarded)
    reviewed = reviewed.drop(*[n for n in reviewed.columns if n.endswith("_findings")])
    if matches is None:
        return sc.score(reviewed)
    if requests is None:
        raise ValueError("matches need the requests they were made for")
    joined = ordered.salted_join(
        matches, reviewed, "doc_id", ["posting_id"], how="inner", counted=requests
    )
    return sc.score(
        joined.withColumn("findings", F.concat("findings", ru.keyword_findings()))
    )


def findings_table(reviews: DataFrame, *keys: str) -> DataFrame:
    """Long findings in report order."""
    return unnest(reviews, list(keys), "findings", "finding_no").withColumn(
        "finding_no", F.col("finding_no") + 1
    )


def errors_table(reviews: DataFrame, *keys: str) -> DataFrame:
    """Rules that failed, one row for each document they failed on."""
    failed = reviews.select(*keys, F.explode_outer("rule_errors").alias("rule_id"))
    return failed.filter(F.col("rule_id").isNotNull())


def category_table(reviews: DataFrame, *keys: str) -> DataFrame:
    return unnest(reviews, list(keys), "category_scores")


def priority_table(reviews: DataFrame, *keys: str) -> DataFrame:
    return unnest(reviews, list(keys), "priorities")
