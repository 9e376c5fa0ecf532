"""Category scores, overall score, finding order, priorities and projected gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalens import lexicon as lx
from vitalens.functions.core import built_once, let, let_struct, round1

PRIORITY_LIMIT = 5


def severity_rank(severity: Column) -> Column:
    out = None
    for name, rank in lx.SEVERITY_RANK.items():
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out


def category_weight(category: Column) -> Column:
    out = None
    for name, weight in lx.CATEGORY_WEIGHTS:
        out = F.when(category == name, weight) if out is None else out.when(category == name, weight)
    return out


def band(score: Column) -> Column:
    out = None
    for floor, name in lx.BANDS:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise(lx.BANDS[-1][1])


def category_scores(findings: Column, has_posting: Column) -> Column:
    """One entry per category: 100 minus its penalties, clipped; 0 where not applicable."""
    cats = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.lit(w).alias("weight"))
            for c, w in lx.CATEGORY_WEIGHTS
        ]
    )

    def score(v: Column) -> Column:
        def one(c: Column) -> Column:
            own = F.filter(v["fs"], lambda f: f["category"] == c["category"])
            return let(
                own,
                lambda fs: F.struct(
                    c["category"].alias("category"),
                    c["weight"].alias("weight"),
                    ((c["category"] != "keywords") | v["posting"]).alias("applicable"),
                    F.aggregate(fs, F.lit(0.0), lambda acc, f: acc + f["penalty"]).alias("penalties"),
                    F.size(F.filter(fs, lambda f: f["severity"] != "positive")).alias(
                        "finding_count"
                    ),
                    F.size(F.filter(fs, lambda f: f["severity"] == "critical")).alias(
                        "critical_count"
                    ),
                ),
            )

        return F.transform(
            F.transform(cats, one),
            lambda c: F.struct(
                c["category"].alias("category"),
                F.when(
                    c["applicable"],
                    F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - c["penalties"])),
                )
                .otherwise(0.0)
                .alias("score"),
                *[
                    c[n].alias(n)
                    for n in ("weight", "finding_count", "critical_count", "penalties", "applicable")
                ],
            ),
        )

    return let_struct(score, fs=findings, posting=has_posting)


def overall(cats: Column) -> Column:
    """Weighted mean over applicable categories."""

    def mean(cs: Column) -> Column:
        total = F.aggregate(cs, F.lit(0.0), lambda acc, c: acc + c["score"] * c["weight"])
        weight = F.aggregate(cs, F.lit(0.0), lambda acc, c: acc + c["weight"])
        return total / F.nullif(weight, F.lit(0.0))

    return let(F.filter(cats, lambda c: c["applicable"]), mean)


def gain(penalty: Column, category: Column) -> Column:
    """Points of the overall score a fix is worth."""
    return penalty * category_weight(category) / F.lit(100.0)


def ordered_findings(findings: Column) -> Column:
    """By severity, penalty (largest first), category, id."""
    keyed = F.transform(
        findings,
        lambda f: F.struct(
            severity_rank(f["severity"]).alias("rank"),
            (-f["penalty"]).alias("neg"),
            f["category"].alias("category"),
            f["rule_id"].alias("rule_id"),
            f.alias("f"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def priorities(findings: Column, limit: int = PRIORITY_LIMIT) -> Column:
    """Fixes with most weighted gain first: (rule_id, category, severity, penalty, overall_gain)."""
    actionable = F.filter(
        findings, lambda f: (f["severity"] != "positive") & (f["penalty"] > 0)
    )
    keyed = F.transform(
        actionable,
        lambda f: F.struct(
            (-gain(f["penalty"], f["category"])).alias("neg_gain"),
            severity_rank(f["severity"]).alias("rank"),
            (-f["penalty"]).alias("neg"),
            f["category"].alias("category"),
            f["rule_id"].alias("rule_id"),
            f.alias("f"),
        ),
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, limit),
        lambda k, i: F.struct(
            (i + 1).alias("rank"),
            k["rule_id"].alias("rule_id"),
            k["category"].alias("category"),
            k["f"]["severity"].alias("severity"),
            k["f"]["penalty"].alias("penalty"),
            k["f"]["evidence"].alias("evidence"),
            k["f"]["section"].alias("section"),
            round1(-k["neg_gain"]).alias("overall_gain"),
        ),
    )


def projected(overall_score: Column, prios: Column) -> Column:
    """Score if every listed fix lands, at most 100, to one decimal."""
    gains = F.aggregate(prios, F.lit(0.0), lambda acc, p: acc + p["overall_gain"])
    return round1(F.least(F.lit(100.0), overall_score + gains))


@built_once
def _score_columns() -> tuple[dict[str, Column], ...]:
    return (
        {
            "category_scores": category_scores(F.col("findings"), F.col("has_posting")),
            "findings": ordered_findings(F.col("findings")),
            "priorities": priorities(F.col("findings")),
        },
        {"overall": overall(F.col("category_scores"))},
        {
            "band": band(F.col("overall")),
            "projected_score": projected(F.col("overall"), F.col("priorities")),
        },
    )


def score(df: DataFrame) -> DataFrame:
    """Add category_scores, overall, band, priorities, projected_score to rows with findings.

    ``has_posting`` says whether the job-match category applies; absent means no.  Rows without
    findings (null: the review failed) have no scores.
    """
    out = df if "has_posting" in df.columns else df.withColumn("has_posting", F.lit(False))
    reviewed = F.col("findings").isNotNull()
    for columns in _score_columns():
        out = out.withColumns({n: F.when(reviewed, c) for n, c in columns.items()})
    return out


# --- relational forms over long tables ---------------------------------------------------------


def score_long_findings(findings: DataFrame, applicable: DataFrame) -> DataFrame:
    """Category scores from a long findings table.

    ``applicable`` lists the categories of each review (review_id, category);
    both sides are reduced to at most six rows per review before they meet.
    """
    sums = findings.groupBy("review_id", "category").agg(
        F.sum("penalty").alias("penalties"),
        F.count_if(F.col("severity") != "positive").alias("finding_count"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
    )
    return (
        applicable.join(sums, ["review_id", "category"], "left")
        .withColumn("penalties", F.coalesce("penalties", F.lit(0.0)))
        .select(
            "review_id",
            "category",
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - F.col("penalties"))).alias(
                "score"
            ),
            category_weight(F.col("category")).alias("weight"),
            F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
            F.coalesce("critical_count", F.lit(0)).alias("critical_count"),
            "penalties",
        )
    )
