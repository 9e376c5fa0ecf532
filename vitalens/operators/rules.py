"""The rule catalogue and its emitter: features in, findings out.

A rule is data: an id, a category, a severity and column builders over the
profile of a document.  All rules of a catalogue are evaluated in one
projection, so adding a rule never adds a pass over the corpus.

The rules of this module cannot raise errors.  Rules that are registered can: they are
evaluated in a form that turns an error into a value, so a rule that divides by zero or casts
badly fails alone and is named in ``rule_errors`` of the documents it failed on.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalens import lexicon as lx
from vitalens.functions import text as tx
from vitalens.functions.core import Add, built_once, empty_strings, first_of, is_sound, let, let_struct, most_common
from vitalens.operators import timeline as tl

EVIDENCE_ITEMS = 5
EVIDENCE_CHARS = 240
FINDING_TYPE = (
    "struct<rule_id:string,category:string,severity:string,penalty:double,"
    "evidence:array<string>,section:string>"
)

Build = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """``when``, ``penalty``, ``severity`` and ``evidence`` receive the profile struct.

    A ``guarded`` rule may raise errors; it is evaluated twice.
    """

    rule_id: str
    severity: str | Build
    penalty: float | Build
    when: Build
    evidence: Build | None = None
    category: str = ""
    section: str | None = None
    guarded: bool = False

    def __post_init__(self):
        if not self.category:
            object.__setattr__(self, "category", self.rule_id.split(".")[0])


@dataclass(frozen=True)
class Catalogue:
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def register(self, rule: Rule, guarded: bool = True) -> Catalogue:
        """A new catalogue with one more rule, guarded unless it is known to raise no errors."""
        return replace(self, rules=(*self.rules, replace(rule, guarded=guarded)))


def bounded_evidence(items: Column) -> Column:
    """Stripped, non-empty, at most 240 characters each, at most 5."""
    return F.slice(
        F.filter(
            F.transform(items, lambda e: F.substring(tx.ustrip(e), 1, EVIDENCE_CHARS)),
            lambda e: e != "",
        ),
        1,
        EVIDENCE_ITEMS,
    )


def _emit_one(rule: Rule, v: Column) -> Column:
    found = _finding(rule, v)
    return F.when(is_sound(found), found) if rule.guarded else found


def _finding(rule: Rule, v: Column) -> Column:
    severity = F.lit(rule.severity) if isinstance(rule.severity, str) else rule.severity(v)
    penalty = rule.penalty(v) if callable(rule.penalty) else F.lit(float(rule.penalty))
    evidence = bounded_evidence(rule.evidence(v)) if rule.evidence else empty_strings()
    return F.when(
        rule.when(v),
        F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.category).alias("category"),
            severity.alias("severity"),
            F.when(severity == "positive", F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), penalty.cast("double")))
            .alias("penalty"),
            evidence.alias("evidence"),
            F.lit(rule.section).cast("string").alias("section"),
        ),
    )


def emit(catalogue: Catalogue, v: Column) -> Column:
    """Findings of every rule that fires."""
    return F.filter(
        F.array(*[_emit_one(r, v) for r in catalogue.rules]), lambda x: x.isNotNull()
    )


def failures(catalogue: Catalogue, v: Column) -> Column:
    """Ids of rules that raised an error or whose condition came out null; they fail alone, never the document."""

    def failed(rule: Rule) -> Column:
        undecided = rule.when(v).isNull()
        return F.when(~is_sound(_finding(rule, v)), True).otherwise(undecided) if rule.guarded else undecided

    return F.filter(
        F.array(*[F.when(failed(r), F.lit(r.rule_id)) for r in catalogue.rules]),
        lambda x: x.isNotNull(),
    )


# --- fixed values: ids, severities, penalties and thresholds of all rules below ---

# --- contact ------------------------------------------------------------------------------


def _contact_rules() -> list[Rule]:
    c = lambda v, name: v["contact"][name]
    primary = lambda v: first_of(c(v, "emails"))
    informal = lambda v: F.split_part(primary(v), F.lit("@"), F.lit(1)).rlike(
        lx.INFORMAL_LOCAL
    )
    dated = lambda v: F.lower(F.split_part(primary(v), F.lit("@"), F.lit(2))).isin(
        *lx.DATED_DOMAINS
    )
    has_email = lambda v: F.size(c(v, "emails")) > 0
    has_phone = lambda v: F.size(c(v, "phones")) > 0
    return [
        Rule("contact.name_missing", "critical", 25, lambda v: F.coalesce(c(v, "name"), F.lit("")) == ""),
        Rule("contact.email_missing", "critical", 40, lambda v: ~has_email(v)),
        Rule(
            "contact.email_unprofessional", "warning", 15,
            lambda v: has_email(v) & informal(v),
            lambda v: F.array(primary(v)),
        ),
        Rule(
            "contact.email_dated_domain", "suggestion", 4,
            lambda v: has_email(v) & ~informal(v) & dated(v),
            lambda v: F.array(primary(v)),
        ),
        Rule(
            "contact.email_multiple", "suggestion", 5,
            lambda v: F.size(c(v, "emails")) > 1,
            lambda v: F.slice(c(v, "emails"), 1, 3),
        ),
        Rule("contact.phone_missing", "warning", 15, lambda v: ~has_phone(v)),
        Rule("contact.linkedin_missing", "suggestion", 8, lambda v: c(v, "linkedin").isNull()),
        Rule(
            "contact.portfolio_missing", "suggestion", 5,
            lambda v: c(v, "github").isNull() & (F.size(c(v, "websites")) == 0),
        ),
        Rule("contact.location_missing", "suggestion", 6, lambda v: c(v, "location").isNull()),
        Rule(
            "contact.sensitive_data", "warning", 18,
            lambda v: F.size(c(v, "sensitive")) > 0,
            lambda v: F.slice(c(v, "sensitive"), 1, 4),
        ),
        Rule(
            "contact.complete", "positive", 0,
            lambda v: has_email(v) & has_phone(v) & c(v, "linkedin").isNotNull(),
        ),
    ]


# --- structure ----------------------------------------------------------------------------


def _structure_rules() -> list[Rule]:
    s = lambda v, name: v["structure"][name]
    required = []
    for n in lx.REQUIRED_SECTIONS:
        required += [
            Rule(
                f"structure.empty_{n}", "critical", 22,
                lambda v, n=n: ~s(v, f"has_{n}") & s(v, f"heads_{n}"),
            ),
            Rule(
                f"structure.missing_{n}", "critical", 22,
                lambda v, n=n: ~s(v, f"has_{n}") & ~s(v, f"heads_{n}"),
            ),
        ]
    return [
        *required,
        Rule("structure.missing_summary", "warning", 10, lambda v: ~s(v, "has_summary")),
        Rule(
            "structure.education_before_experience", "warning", 12,
            lambda v: (s(v, "experience_at") > 0)
            & (s(v, "education_at") > 0)
            & (s(v, "education_at") < s(v, "experience_at"))
            & (v["timeline"]["months"] > 36),
        ),
        Rule("structure.summary_not_first", "suggestion", 6, lambda v: s(v, "summary_at") > 2),
        Rule(
            "structure.low_value_sections", "suggestion", 5,
            lambda v: F.size(s(v, "low_value")) > 0,
            lambda v: s(v, "low_value"),
        ),
        Rule(
            "structure.experience_thin", "warning", 10,
            lambda v: (s(v, "experience_words") > 0)
            & (s(v, "experience_words") / F.greatest(s(v, "section_words"), F.lit(1)) < 0.35),
        ),
        Rule("structure.skills_bloated", "suggestion", 6, lambda v: s(v, "skills_words") > 120),
        Rule(
            "structure.skills_obsolete", "suggestion", 5,
            lambda v: (s(v, "skills_words") > 0) & s(v, "skills_obsolete"),
        ),
        Rule(
            "structure.complete", "positive", 0,
            lambda v: s(v, "has_experience") & s(v, "has_education") & s(v, "has_skills") & s(v, "has_summary"),
        ),
    ]


# --- impact ---------------------------------------------------------------------------------


def _impact_rules() -> list[Rule]:
    i = lambda v, name: v["impact"][name]
    n = lambda v: i(v, "bullets")
    some = lambda v: n(v) > 0
    share = lambda v, name: i(v, name) / F.greatest(n(v), F.lit(1))
    return [
        Rule("impact.no_bullets", "critical", 45, lambda v: n(v) == 0),
        Rule(
            "impact.no_metrics", "critical", 32,
            lambda v: some(v) & (share(v, "quantified") < 0.20),
            lambda v: i(v, "unquantified_bodies"),
        ),
        Rule(
            "impact.few_metrics", "warning", 16,
            lambda v: some(v) & (share(v, "quantified") >= 0.20) & (share(v, "quantified") < 0.45),
            lambda v: i(v, "unquantified_bodies"),
        ),
        Rule(
            "impact.well_quantified", "positive", 0,
            lambda v: some(v) & (share(v, "quantified") >= 0.6),
            lambda v: i(v, "quantified_bodies"),
        ),
        Rule(
            "impact.weak_openers",
            lambda v: F.when(share(v, "weak") > 0.4, "critical").otherwise("warning"),
            lambda v: F.least(F.lit(26.0), i(v, "weak") * F.lit(7.0)),
            lambda v: i(v, "weak") > 0,
            lambda v: i(v, "weak_bodies"),
        ),
        Rule(
            "impact.strong_verbs", "positive", 0,
            lambda v: some(v) & (i(v, "weak") == 0) & (share(v, "strong") >= 0.7),
        ),
        Rule(
            "impact.few_action_verbs", "warning", 14,
            lambda v: some(v) & (i(v, "weak") == 0) & (share(v, "strong") < 0.4),
            lambda v: i(v, "not_strong_bodies"),
        ),
        Rule(
            "impact.repeated_verbs", "suggestion", 5,
            lambda v: (n(v) >= 6) & (i(v, "top_opener")["n"] >= 4),
        ),
        Rule(
            "impact.filler_phrases", "warning",
            lambda v: F.least(F.lit(14.0), F.size(i(v, "fillers")) * F.lit(3.5)),
            lambda v: some(v) & (F.size(i(v, "fillers")) > 0),
            lambda v: i(v, "fillers"),
        ),
        Rule(
            "impact.cliches", "warning",
            lambda v: F.least(F.lit(16.0), F.size(i(v, "cliches")) * F.lit(4.0)),
            lambda v: some(v) & (F.size(i(v, "cliches")) > 0),
            lambda v: i(v, "cliches"),
        ),
        Rule(
            "impact.first_person", "suggestion", 7,
            lambda v: some(v) & (i(v, "pronouns")["n"] >= 3),
            lambda v: i(v, "pronouns")["sample"],
        ),
        Rule(
            "impact.bullets_too_long", "warning", 10,
            lambda v: i(v, "long") >= F.greatest(F.lit(2.0), n(v) * F.lit(0.25)),
            lambda v: i(v, "long_bodies"),
        ),
        Rule(
            "impact.bullets_too_short", "suggestion", 7,
            lambda v: i(v, "short") >= F.greatest(F.lit(2.0), n(v) * F.lit(0.3)),
            lambda v: i(v, "short_bodies"),
        ),
        Rule(
            "impact.mixed_tense", "suggestion", 5,
            lambda v: (i(v, "tense_sample") >= 4)
            & (i(v, "past") > 0)
            & (i(v, "gerund") > 0)
            & (F.abs(i(v, "past") - i(v, "gerund")) < i(v, "tense_sample") * F.lit(0.5)),
        ),
    ]


# --- machine readability ------------------------------------------------------------------------


def _ats_rules() -> list[Rule]:
    d = lambda v, name: v["layout"][name]
    s = lambda v, name: v["structure"][name]
    clean = lambda v: ~(
        d(v, "is_scanned")
        | (d(v, "multi_column_pages") > 0)
        | (d(v, "table_count") > 0)
        | d(v, "has_header_footer_text")
        | (d(v, "image_count") >= 3)
    )
    return [
        Rule("ats.no_text_layer", "critical", 60, lambda v: d(v, "is_scanned")),
        Rule("ats.multi_column", "critical", 30, lambda v: d(v, "multi_column_pages") > 0),
        Rule("ats.tables", "warning", 18, lambda v: d(v, "table_count") > 0),
        Rule("ats.header_footer", "warning", 16, lambda v: d(v, "has_header_footer_text")),
        Rule("ats.image_heavy", "warning", 12, lambda v: d(v, "image_count") >= 3),
        Rule("ats.images_present", "suggestion", 4, lambda v: d(v, "image_count").between(1, 2)),
        Rule(
            "ats.creative_headings", "warning", 14,
            lambda v: F.size(s(v, "creative")) > 0,
            lambda v: F.slice(s(v, "creative"), 1, 4),
        ),
        Rule(
            "ats.unrecognised_headings", "suggestion", 7,
            lambda v: (F.size(s(v, "creative")) == 0) & (F.size(s(v, "unlabelled")) >= 3),
            lambda v: F.slice(s(v, "unlabelled"), 1, 4),
        ),
        Rule(
            "ats.exotic_characters", "suggestion", 6,
            lambda v: v["format"]["exotic"]["n"] > 12,
            lambda v: F.array(v["format"]["exotic"]["sample"]),
        ),
        Rule(
            "ats.no_parsable_dates", "critical", 25,
            lambda v: s(v, "has_experience") & (v["timeline"]["ranges"] == 0),
        ),
        Rule("ats.clean_layout", "positive", 0, clean),
    ]


# --- formatting -----------------------------------------------------------------------------------


def _formatting_rules(legacy_gap_labels: bool = False) -> list[Rule]:
    words = lambda v: v["layout"]["word_count"]
    excess = lambda v: v["layout"]["page_count"] - tl.expected_pages(v["timeline"]["months"])
    t = lambda v, name: v["timeline"][name]
    lines = lambda v, name: v["format"]["line_stats"][name]
    wide_gaps = lambda v: F.filter(t(v, "gaps"), lambda g: g["months"] >= 9)
    return [
        Rule(
            "formatting.too_long", "warning",
            lambda v: F.least(F.lit(24.0), excess(v) * F.lit(12.0)),
            lambda v: excess(v) > 0,
        ),
        Rule("formatting.too_short", "critical", 30, lambda v: words(v) < 250),
        Rule("formatting.thin", "warning", 12, lambda v: words(v).between(250, 349)),
        Rule("formatting.verbose", "warning", 12, lambda v: words(v) > 1200),
        Rule(
            "formatting.date_format_mixed", "suggestion", 6,
            lambda v: (t(v, "with_month") > 0) & (t(v, "with_month") < t(v, "ranges")),
            lambda v: t(v, "raws"),
        ),
        Rule(
            "formatting.multiple_current", "suggestion", 5,
            lambda v: t(v, "current") > 2,
            lambda v: t(v, "current_raws"),
        ),
        Rule(
            "formatting.employment_gaps", "suggestion", 6,
            lambda v: F.size(wide_gaps(v)) > 0,
            lambda v: F.transform(
                F.slice(wide_gaps(v), 1, 3),
                lambda g: F.concat(
                    tl.gap_label(g["after"], legacy_gap_labels),
                    F.lit(" to "),
                    tl.gap_label(g["before"], legacy_gap_labels),
                ),
            ),
        ),
        Rule(
            "formatting.dense_lines", "suggestion", 6,
            lambda v: lines(v, "overlong")
            > F.greatest(F.lit(3.0), lines(v, "filled") * F.lit(0.15)),
        ),
        Rule(
            "formatting.no_whitespace", "suggestion", 5,
            lambda v: (lines(v, "filled") > 30)
            & (F.lit(1.0) - lines(v, "filled") / lines(v, "lines") < 0.08),
        ),
        Rule(
            "formatting.caps_overuse", "suggestion", 5,
            lambda v: v["format"]["caps"]["n"] > 4,
            lambda v: v["format"]["caps"]["sample"],
        ),
        Rule(
            "formatting.well_sized", "positive", 0,
            lambda v: (excess(v) <= 0) & words(v).between(350, 1000),
        ),
    ]


# --- job match --------------------------------------------------------------------------------------


@built_once
def keyword_catalogue() -> Catalogue:
    """Rules over a struct of coverage, matched, missing (terms, weights) and has_skills."""
    cov = lambda v: v["coverage"]
    names = lambda ts, n: F.slice(F.transform(ts, lambda t: t["term"]), 1, n)
    heavy = lambda v: F.filter(v["missing"], lambda t: t["weight"] >= 4)
    applies = lambda v: cov(v).isNotNull()
    return Catalogue(
        (
            Rule(
                "keywords.low_coverage", "critical", 45,
                lambda v: applies(v) & (cov(v) < 0.35), lambda v: names(v["missing"], 8),
            ),
            Rule(
                "keywords.partial_coverage", "warning", 20,
                lambda v: applies(v) & (cov(v) >= 0.35) & (cov(v) < 0.6),
                lambda v: names(v["missing"], 8),
            ),
            Rule(
                "keywords.strong_coverage", "positive", 0,
                lambda v: applies(v) & (cov(v) >= 0.6), lambda v: names(v["matched"], 6),
            ),
            Rule(
                "keywords.critical_missing", "warning", 15,
                lambda v: applies(v) & (F.size(heavy(v)) > 0), lambda v: names(heavy(v), 5),
            ),
            Rule(
                "keywords.no_skills_section", "warning", 12,
                lambda v: applies(v) & ~v["has_skills"] & (F.size(v["missing"]) > 0),
            ),
        )
    )


@built_once
def document_catalogue(legacy_gap_labels: bool = False) -> Catalogue:
    """Every rule that needs only the document."""
    return Catalogue(
        tuple(
            _contact_rules()
            + _structure_rules()
            + _impact_rules()
            + _ats_rules()
            + _formatting_rules(legacy_gap_labels)
        )
    )


# --- section attribution -------------------------------------------------------------------------


def attribute_sections(findings: Column, secs: Column, judged: Column, has_experience: Column) -> Column:
    """Fill ``section`` of each finding: the part of the document it is about; null = whole document.

    Impact findings go to the section holding most of their quoted evidence,
    else to the section with most judged bullets, else to experience.
    """
    fixed = F.create_map(*[F.lit(x) for kv in lx.SECTION_OF_RULE.items() for x in kv])

    def attribute(v: Column) -> Column:
        def located(f: Column) -> Column:
            needles = F.filter(
                F.transform(f["evidence"], lambda e: tx.ustrip(tx.flatten_text(e))),
                lambda e: F.length(e) >= 4,
            )
            homes = F.transform(
                needles,
                lambda e: first_of(F.filter(v["flats"], lambda s: F.contains(s["flat"], e)))["name"],
            )
            return most_common(F.filter(homes, lambda h: h.isNotNull()))

        fallback = F.when(
            ~F.coalesce(v["top"].isin("unknown", "header"), F.lit(True)), v["top"]
        ).otherwise(F.when(v["has_exp"], F.lit("experience")))

        def home(f: Column) -> Column:
            rid = f["rule_id"]
            return (
                F.when(f["section"].isNotNull(), f["section"])
                .when(F.map_contains_key(fixed, rid), F.try_element_at(fixed, rid))
                .when(rid.startswith("contact."), F.lit("header"))
                .when(
                    rid.startswith("structure.missing_") | rid.startswith("structure.empty_"),
                    F.split_part(rid, F.lit("_"), F.lit(-1)),
                )
                .when(rid == "structure.low_value_sections", first_of(f["evidence"]))
                .when(rid.startswith("impact."), F.coalesce(located(f), fallback))
            )

        return F.transform(
            v["findings"],
            lambda f: F.struct(
                *[f[c].alias(c) for c in ("rule_id", "category", "severity", "penalty", "evidence")],
                home(f).alias("section"),
            ),
        )

    return let_struct(
        attribute,
        findings=findings,
        has_exp=has_experience,
        flats=F.transform(
            F.filter(secs, lambda s: (s["name"] != "unknown") & (s["text"] != "")),
            lambda s: F.struct(s["name"].alias("name"), tx.flatten_text(s["text"]).alias("flat")),
        ),
        top=most_common(F.transform(judged, lambda b: b["section"])),
    )


#: What the rules of this module read of a profile, by category; rules that are registered may read all of it.
READS = {
    "contact": ("contact",),
    "structure": ("structure", "timeline"),
    "impact": ("impact",),
    "ats": ("layout", "structure", "timeline", "format"),
    "formatting": ("layout", "timeline", "format"),
}
PARTS = ("contact", "structure", "impact", "layout", "timeline", "format")


def _profiled(names: tuple[str, ...]) -> dict[str, Column]:
    # The sections are counted for the rules in any case: ``sized`` has the words of the text from them.
    return {n: F.col("sized" if n == "layout" else n) for n in names}


def _groups(cat: Catalogue) -> list[tuple[str, Catalogue, tuple[str, ...]]]:
    """(name, rules, parts they read): neighbouring rules of one category, in the order of the catalogue."""
    own = set(map(id, (*document_catalogue().rules, *document_catalogue(True).rules)))
    groups: list[tuple[str, list[Rule], tuple[str, ...]]] = []
    for r in cat.rules:
        reads = READS[r.category] if id(r) in own else PARTS
        if groups and groups[-1][1][-1].category == r.category and groups[-1][2] == reads:
            groups[-1][1].append(r)
        else:
            groups.append((f"_raw_{len(groups)}_{r.category}", [r], reads))
    return [(n, Catalogue(tuple(rs)), reads) for n, rs, reads in groups]


@built_once
def _finding_columns(cat: Catalogue) -> tuple[dict[str, Column], ...]:
    # Columns of their own: Spark prunes the rules of categories that a caller does not read, and what only they read.
    groups = _groups(cat)
    raw = {n: let_struct(functools.partial(emit, rules), **_profiled(reads)) for n, rules, reads in groups}
    whole = F.concat(*map(F.col, raw)) if raw else F.array().cast(f"array<{FINDING_TYPE}>")
    return (
        raw | {"rule_errors": let_struct(lambda v: failures(cat, v), **_profiled(PARTS))},
        {
            f"{c}_findings": F.concat(*[F.col(n) for n, rules, _ in groups if rules.rules[0].category == c])
            for c in dict.fromkeys(r.category for r in cat.rules)
        }
        | {"raw_findings": whole},
        {
            "findings": attribute_sections(
                F.col("raw_findings"),
                F.col("secs"),
                F.col("judged"),
                F.col("structure")["has_experience"],
            )
        },
    )


def document_findings(
    profiled: DataFrame, catalogue: Catalogue | None = None, add: Add = DataFrame.withColumns
) -> DataFrame:
    """Add ``findings`` (attributed) and ``rule_errors`` to a profiled corpus.

    ``contact_findings`` and so on hold the findings of one category, not attributed to sections.
    """
    out = profiled
    for columns in _finding_columns(catalogue or document_catalogue()):
        out = add(out, columns)
    return out.drop("raw_findings", *[n for n, _, _ in _groups(catalogue or document_catalogue())])


@built_once
def keyword_findings() -> Column:
    """Job-match findings over coverage, matched, missing and has_skills."""
    names = ("coverage", "matched", "missing", "has_skills")
    return attribute_fixed(
        let_struct(lambda v: emit(keyword_catalogue(), v), **{n: F.col(n) for n in names})
    )


def attribute_fixed(findings: Column) -> Column:
    """Sections of findings whose rule alone decides it (job-match rules)."""
    fixed = F.create_map(*[F.lit(x) for kv in lx.SECTION_OF_RULE.items() for x in kv])
    return F.transform(
        findings,
        lambda f: F.struct(
            *[f[c].alias(c) for c in ("rule_id", "category", "severity", "penalty", "evidence")],
            F.coalesce(f["section"], F.try_element_at(fixed, f["rule_id"])).alias("section"),
        ),
    )
