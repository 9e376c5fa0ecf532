"""Questions over stored reviews: statistics, latest, deltas, baselines, diffs, erasure.

reviews: review_id, doc_id, owner_id, status, overall, created_at[, target_role, ai_review]
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalens import lexicon as lx
from vitalens.functions.core import round1
from vitalens.operators import ordered

COMPLETE, FAILED = "complete", "failed"
TREND_LENGTH = 50


def is_complete() -> Column:
    return F.col("status") == COMPLETE


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("review_id").desc()]


# --- filters and projections ---------------------------------------------------------


def owned(df: DataFrame, owner: str) -> DataFrame:
    """Rows of one owner; another owner's rows look absent."""
    return df.filter(F.col("owner_id") == owner)


def completed(reviews: DataFrame) -> DataFrame:
    return reviews.filter(is_complete())


def of_document(reviews: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Filter by document only when one is given."""
    return reviews if doc_id is None else reviews.filter(F.col("doc_id") == doc_id)


def of_documents(reviews: DataFrame, wanted: DataFrame) -> DataFrame:
    return reviews.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")


def summaries(reviews: DataFrame, *more: str) -> DataFrame:
    return reviews.select(
        *more,
        "review_id",
        "doc_id",
        "status",
        "overall",
        "created_at",
        F.col("ai_review").isNotNull().alias("has_ai_review"),
    )


def with_target_role(requests: DataFrame, owners: DataFrame) -> DataFrame:
    """Requested role, else the owner's default."""
    return requests.join(
        owners.select("owner_id", F.col("target_role").alias("_default")), "owner_id", "left"
    ).select(
        *[c for c in requests.columns if c != "target_role"],
        F.coalesce(F.nullif(F.col("target_role"), F.lit("")), F.col("_default")).alias(
            "target_role"
        ),
    )


def score_colour(score: Column) -> Column:
    return F.when(score >= 85, "green").when(score >= 55, "amber").otherwise("red")


# --- statistics -------------------------------------------------------------------------


def owner_stats(reviews: DataFrame, docs: DataFrame) -> DataFrame:
    """(owner_id, doc_count, review_count, best, latest, delta) over complete reviews."""
    stored = docs.groupBy("owner_id").agg(F.count("doc_id").alias("doc_count"))
    done = completed(reviews)
    totals = done.groupBy("owner_id").agg(
        F.count("review_id").alias("review_count"), F.max("overall").alias("best")
    )
    recent = (
        ordered.top_per_key(
            done.select("owner_id", "review_id", "overall", "created_at"),
            ["owner_id"],
            newest_first(),
            2,
        )
        .groupBy("owner_id")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("overall"))).alias("latest"),
            F.max(F.when(F.col("rank") == 2, F.col("overall"))).alias("previous"),
        )
    )
    return (
        stored.join(totals, "owner_id", "full_outer")
        .join(recent, "owner_id", "left")
        .select(
            "owner_id",
            F.coalesce("doc_count", F.lit(0)).alias("doc_count"),
            F.coalesce("review_count", F.lit(0)).alias("review_count"),
            round1(F.col("best")).alias("best"),
            round1(F.col("latest")).alias("latest"),
            round1(F.col("latest") - F.col("previous")).alias("delta"),
        )
    )


def _document_keys(*tables: DataFrame) -> list[str]:
    """What names a document in all tables: its owner too where they carry it, so that tables
    stored by owner are grouped and joined in place."""
    return [c for c in ("owner_id", "doc_id") if all(c in t.columns for t in tables)]


def review_counts(reviews: DataFrame) -> DataFrame:
    """(doc_id, review_count, last_review_at), every status."""
    return reviews.groupBy("doc_id").agg(
        F.count("review_id").alias("review_count"), F.max("created_at").alias("last_review_at")
    )


def latest_scores(reviews: DataFrame) -> DataFrame:
    """(doc_id, latest_score) from the newest complete review."""
    return (
        completed(reviews)
        .groupBy("doc_id")
        .agg(F.max_by("overall", F.struct("created_at", "review_id")).alias("latest_score"))
    )


def decorate(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Documents with review count and latest score, in one pass over the reviews."""
    keys = _document_keys(docs, reviews)
    newest = F.max_by("overall", F.when(is_complete(), F.struct("created_at", "review_id")))
    known = reviews.groupBy(*keys).agg(F.count("review_id").alias("review_count"), newest.alias("latest_score"))
    return docs.join(known, keys, "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


def document_deltas(reviews: DataFrame) -> DataFrame:
    """Each review with the change since the document's previous one; null unless both complete."""
    prior = ordered.with_prior(
        reviews, ["doc_id"], "created_at", "review_id", ["status", "overall"]
    )
    return prior.select(
        "review_id",
        "doc_id",
        "created_at",
        F.when(
            is_complete() & (F.col("prior.status") == COMPLETE),
            round1(F.col("overall") - F.col("prior.overall")),
        ).alias("delta"),
    )


def owner_deltas(reviews: DataFrame) -> DataFrame:
    """(owner_id, latest, previous, delta) over the two newest complete reviews."""
    top = ordered.top_per_key(completed(reviews), ["owner_id"], newest_first(), 2)
    pair = top.groupBy("owner_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("overall"))).alias("latest"),
        F.max(F.when(F.col("rank") == 2, F.col("overall"))).alias("previous"),
    )
    return pair.withColumn("delta", round1(F.col("latest") - F.col("previous")))


def trend(reviews: DataFrame, limit: int = TREND_LENGTH) -> DataFrame:
    """Per owner, complete reviews among the newest ``limit``, oldest first."""
    top = ordered.top_per_key(reviews, ["owner_id"], newest_first(), limit)
    kept = top.filter(is_complete())
    return kept.select(
        "owner_id",
        "review_id",
        "doc_id",
        F.col("overall").alias("score"),
        "created_at",
        (F.lit(limit) - F.col("rank")).alias("position"),
    )


# --- lists ----------------------------------------------------------------------------------


def with_filename(reviews: DataFrame, docs: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """Reviews with their document's file name; null when the document is gone."""
    return ordered.salted_join(
        reviews, docs.select("doc_id", "filename"), "doc_id", ["review_id"], hot_rows=hot_rows
    )


def history(
    reviews: DataFrame,
    docs: DataFrame,
    owner: str,
    limit: int = 25,
    offset: int = 0,
    doc_id: str | None = None,
) -> DataFrame:
    """One page of an owner's reviews, newest first, 1 to 100 rows."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100 and offset at least 0")
    page = (
        of_document(owned(reviews, owner), doc_id)
        .orderBy(*newest_first())
        .offset(offset)
        .limit(limit)
    )
    # A page holds at most 100 rows, so it is ordered as one array: a sort above the join is
    # dropped when the plan is optimised again at run time, as if the join kept the page's order.
    named = page.join(docs.select("doc_id", "filename"), "doc_id", "left")
    keys = ["created_at", "review_id"]
    row = F.struct(*keys, *[c for c in named.columns if c not in keys])
    return named.agg(F.sort_array(F.collect_list(row), asc=False).alias("rows")).select(
        F.inline("rows")
    )


def sort_history(reviews: DataFrame, order: str = "newest") -> DataFrame:
    keys = {
        "newest": newest_first(),
        "highest": [F.col("overall").desc(), *newest_first()],
        "lowest": [F.col("overall").asc(), *newest_first()],
    }
    return reviews.orderBy(*keys[order])


def documents_newest_first(docs: DataFrame, owner: str) -> DataFrame:
    return owned(docs, owner).orderBy(F.col("created_at").desc(), F.col("doc_id").desc())


def within_quota(uploads: DataFrame, limit: int = lx.MAX_STORED_PER_OWNER) -> DataFrame:
    """Uploads with ``accepted``: the first ``limit`` of each owner in upload order."""
    kept = ordered.top_per_key(
        uploads.select("owner_id", "doc_id", "created_at"),
        ["owner_id"],
        [F.col("created_at"), F.col("doc_id")],
        limit,
    ).select("doc_id", F.lit(True).alias("accepted"))
    return uploads.join(kept, "doc_id", "left").withColumn(
        "accepted", F.coalesce("accepted", F.lit(False))
    )


# --- comparison --------------------------------------------------------------------------------


def baselines(reviews: DataFrame, bucket: str = "day") -> DataFrame:
    """(review_id, baseline_id) of each complete review.

    The baseline is the latest strictly earlier complete review of the same
    document, else of any document of the owner.
    """
    done = completed(reviews).select("review_id", "doc_id", "owner_id", "created_at")
    by_doc = ordered.with_prior(
        done, ["owner_id", "doc_id"], "created_at", "review_id", [], strict=True, bucket=bucket,
        out="same_doc",
    )
    by_owner = ordered.with_prior(
        by_doc, ["owner_id"], "created_at", "review_id", [], strict=True, bucket=bucket,
        out="same_owner",
    )
    return by_owner.select(
        "review_id",
        F.coalesce("same_doc.review_id", "same_owner.review_id").alias("baseline_id"),
    )


def check_pairs(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Requested comparisons (review_id, baseline_id) with ``reason``; null means allowed."""
    facts = reviews.select("review_id", "owner_id", "status")
    cur = facts.select(
        "review_id", F.col("owner_id").alias("_owner"), F.col("status").alias("_status")
    )
    base = facts.select(
        F.col("review_id").alias("baseline_id"),
        F.col("owner_id").alias("_base_owner"),
        F.col("status").alias("_base_status"),
    )
    joined = pairs.join(cur, "review_id", "left").join(base, "baseline_id", "left")
    return joined.select(
        "review_id",
        "baseline_id",
        F.when(F.col("_owner").isNull(), "review_not_found")
        .when(F.col("_status") != COMPLETE, "review_incomplete")
        .when(F.col("review_id") == F.col("baseline_id"), "same_review")
        .when(
            F.col("_base_owner").isNull()
            | (F.col("_base_owner") != F.col("_owner"))
            | (F.col("_base_status") != COMPLETE),
            "baseline_not_found",
        )
        .alias("reason"),
    )


# --- findings views --------------------------------------------------------------------------------


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("review_id", "severity").agg(F.count("*").alias("n"))


def of_severity(findings: DataFrame, severity: str | None = None) -> DataFrame:
    return findings if severity is None else findings.filter(F.col("severity") == severity)


def layout_cause(findings: Column) -> Column:
    """Whether the findings of a review hold a multi-column layout together with an empty required section."""
    return F.exists(findings, lambda f: f["rule_id"] == "ats.multi_column") & F.exists(
        findings, lambda f: f["rule_id"].startswith("structure.empty_")
    )


def grouped_by_section(findings: DataFrame, section_order: DataFrame) -> DataFrame:
    """(review_id, group_no, section, findings): whole document first, then document order, then rest.

    A review has at most one finding per rule, so a group is never larger than the catalogue.
    """
    groups = (
        findings.withColumn("section", F.coalesce("section", F.lit("document")))
        .groupBy("review_id", "section")
        .agg(
            F.array_sort(F.collect_list(F.struct("finding_no", "rule_id"))).alias("_items"),
            F.min("finding_no").alias("_first"),
        )
    )
    placed = groups.join(section_order, ["review_id", "section"], "left").withColumn(
        "_key",
        F.struct(
            F.when(F.col("section") == "document", 0)
            .when(F.col("sec_no").isNotNull(), 1)
            .otherwise(2)
            .alias("kind"),
            F.coalesce("sec_no", F.lit(0)).alias("sec_no"),
            F.col("_first").alias("first"),
        ),
    )
    within = Window.partitionBy("review_id").orderBy("_key")
    return placed.withColumn("group_no", F.row_number().over(within)).select(
        "review_id",
        "group_no",
        "section",
        F.array_join(F.transform("_items", lambda x: x["rule_id"]), ",").alias("rules"),
    )


def findings_digest(findings: DataFrame, limit: int = 12) -> DataFrame:
    """(review_id, digest): the first findings that are not positive, one per line."""
    top = ordered.top_per_key(
        findings.filter(F.col("severity") != "positive"),
        ["review_id"],
        [F.col("finding_no")],
        limit,
    )
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "rule_id")
    return top.groupBy("review_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))),
                lambda x: x["line"],
            ),
            "\n",
        ).alias("digest")
    )


# --- erasure -----------------------------------------------------------------------------------------


CHILDREN = ("findings", "category_scores", "priorities", "match_terms")


def erased_reviews(reviews: DataFrame, erased: DataFrame) -> DataFrame:
    """The reviews that go: of erased owners, of erased documents, and erased themselves."""
    gone = None
    for kind, column in (("owner", "owner_id"), ("document", "doc_id"), ("review", "review_id")):
        if column in reviews.columns:
            ids = erased.filter(F.col("kind") == kind).select(F.col("id").cast(reviews.schema[column].dataType).alias(column))
            lost = reviews.join(ids.distinct(), column, "left_semi")
            gone = lost if gone is None else gone.unionByName(lost)
    return gone.dropDuplicates(["review_id"])


def erase(tables: dict[str, DataFrame], erased: DataFrame) -> dict[str, DataFrame]:
    """Remove erased owners and documents with everything that depends on them.

    ``erased`` holds (kind, id) with kind owner, document or review.  ``sinks.erase_stored``
    does the same to stored tables.
    """

    def ids(kind: str, name: str) -> DataFrame:
        return erased.filter(F.col("kind") == kind).select(F.col("id").alias(name)).distinct()

    out = dict(tables)
    for name in ("owners", "docs"):
        for kind, column in (("owner", "owner_id"), ("document", "doc_id")):
            if name in out and column in out[name].columns:
                out[name] = out[name].join(ids(kind, column), column, "left_anti")
    gone = erased_reviews(tables["reviews"], erased).select("review_id")
    for name in ("reviews", *CHILDREN):
        if name in out:
            out[name] = out[name].join(gone, "review_id", "left_anti")
    return out


# --- cubes -----------------------------------------------------------------------------------------

SKETCH_K = 12  # 2^12 registers: the estimate of distinct documents has a standard error of 1.6 %
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_K / 2)


def review_cube(reviews: DataFrame, dimensions: list[str]) -> DataFrame:
    """All groupings of complete reviews by ``dimensions``: (dimensions, grouping_id, n, best, mean, documents).

    Reviews are counted at the finest grain first, with a mergeable sketch of their documents; the
    cube repeats these few rows for its groupings, not the reviews.  A bit of grouping_id is set
    for each dimension that is summed over, the first dimension's the highest.  ``documents`` is
    an estimate with a relative standard error of SKETCH_ERROR.
    """
    grain = completed(reviews).groupBy(*dimensions).agg(
        F.count("*").alias("n"),
        F.max("overall").alias("best"),
        F.sum(F.col("overall").cast("decimal(20,6)")).alias("total"),
        F.hll_sketch_agg(F.col("doc_id").cast("string"), F.lit(SKETCH_K)).alias("sketch"),
    )
    cube = grain.cube(*dimensions).agg(
        F.grouping_id().cast("int").alias("grouping_id"),
        F.sum("n").alias("n"),
        F.max("best").alias("best"),
        (F.sum("total").cast("double") / F.sum("n")).alias("mean"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("documents"),
    )
    return cube
