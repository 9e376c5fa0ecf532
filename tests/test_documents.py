from conftest import STRONG_CV, TODAY, WEAK_CV
import pytest
from pyspark.sql import functions as F

from vitalens import lexicon as lx
from vitalens.operators import annotate as an
from vitalens.operators import facts as fx
from vitalens.operators import features as ft
from vitalens.operators import rules as ru
from vitalens.operators import sections as sx
from vitalens.operators import timeline as tl
from vitalens.plans import corpus


def by_doc(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out


@pytest.mark.parametrize(
    "line,name",
    [
        ("WORK EXPERIENCE", "experience"), ("Education:", "education"), ("Core Competencies", "skills"),
        ("Technical Skills & Tools", "skills"), ("Selected Research Talks", "publications"),
        ("and technology projects.", None), ("projects", None), ("- Skills here", None),
        ("A Long Line That Is Not Any Heading", None), ("Volunteer Experience", "volunteer"),
    ],
)
def test_heading_names(spark, line, name):
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(sx.heading_name(F.col("l")).alias("n")).first().n == name


def test_sections_and_unnamed_headings(docs_of):
    text = "Ann Lee\n\nSKILLS\nPython\nTOOLBOX\nhammer\n\nOTHER\nx\nEDUCATION\nBSc"
    secs = by_doc(sx.sections_table(docs_of(text, "", "only text\nhere")), "name", "start_line", "end_line")
    # TOOLBOX follows a filled line and starts a section; OTHER follows a blank one and does not.
    assert secs[0] == [("header", 0, 2), ("skills", 2, 4), ("unknown", 4, 9), ("education", 9, 11)]
    assert secs[1] == [("header", 0, 1)] and secs[2] == [("header", 0, 2)]
    blank = by_doc(sx.sections_table(docs_of(text), "blank"), "name", "start_line")
    assert ("unknown", 7) in blank[0] and ("unknown", 4) not in blank[0]


def test_largest_section_prefers_the_first_on_ties(docs_of):
    text = "Name Here\nSKILLS\na b\nEDUCATION\nc\nSKILLS\nd e"
    rows = {r.name: r for r in sx.largest_sections(docs_of(text)).collect()}
    assert rows["skills"].start_line == 1


def test_contact(docs_of):
    c = fx.contacts_table(docs_of(STRONG_CV)).first()
    assert (c.name, c.location) == ("Dana Whitfield", "Portland, OR")
    assert c.emails == ["dana.whitfield@example.org"] and c.phones == ["+1 503 555 0188"]
    assert c.linkedin == "linkedin.com/in/danaw" and c.github == "github.com/danaw" and c.websites == []
    text = "Bo Li\nwww.bo.example.com/a\nb@x.org, c@y.org, b@x.org\nphotography, language: en"
    c = fx.contacts_table(docs_of(text)).first()
    assert c.emails == ["b@x.org", "c@y.org"] and c.websites == ["www.bo.example.com/a"]
    assert c.sensitive == ["age:", "photo reference"]  # containment, not whole words


def test_date_ranges(docs_of):
    text = (
        "Jan 2015 - Jun 2017\n03/2018 to 13/2019; Sept. 2020 until now\n2001-2003, 2004 through 2005\n"
        "May 1, 2019 - 2020"
    )
    got = by_doc(
        fx.date_ranges_table(docs_of(text)),
        "line_no", "start_year", "start_month", "end_year", "end_month", "is_current",
    )[0]
    assert got == [
        (0, 2015, 1, 2017, 6, False), (1, 2018, 3, 2019, None, False), (1, 2020, 9, None, None, True),
        (2, 2001, None, 2003, None, False), (2, 2004, None, 2005, None, False),
        (3, 2019, None, 2020, None, False),
    ]


def test_gaps_and_tenure(docs_of):
    docs = docs_of(
        "Jan 2015 - Jun 2017\nJan 2019 - Present",
        "Jan 2010 - Dec 2010\nMar 2010 - Jun 2010\nDec 2010 - Feb 2011\nOct 2011 - Nov 2011",
        "2020 - 2021",
        "none",
    )
    gaps = by_doc(tl.gaps_table(docs, TODAY), "gap_from", "gap_to", "months")
    assert gaps == {0: [("2017-06", "2019-01", 19)], 1: [("2011-02", "2011-10", 8)]}
    months = {r.doc_id: r.months for r in tl.tenure(docs, TODAY).collect()}
    assert months == {0: 29 + 91, 1: 13 + 1, 2: 23, 3: 0}
    legacy = tl.gaps_table(docs_of("2001 - Dec 2002\nJul 2003 - Present"), TODAY, legacy_gap_labels=True)
    assert [(r.gap_from, r.gap_to) for r in legacy.collect()] == [("2003-12", "2003-07")]


def test_strong_beats_weak(docs_of):
    reviews = {r.doc_id: r for r in corpus.score_corpus(docs_of(STRONG_CV, WEAK_CV, ""), TODAY).collect()}
    strong, weak = reviews[0], reviews[1]
    assert strong.overall > weak.overall + 25
    ids = lambda r, sev=None: {f.rule_id for f in r.findings if sev in (None, f.severity)}
    assert {"impact.weak_openers", "impact.cliches", "impact.filler_phrases", "contact.email_missing"} <= ids(weak)
    assert {"impact.well_quantified", "contact.complete", "structure.complete"} <= ids(strong, "positive")
    for r in reviews.values():
        assert 0 <= r.overall <= 100 and len(r.category_scores) == 6 and len(r.priorities) <= 5
        assert all(p.severity != "positive" for p in r.priorities)
        assert [c.applicable for c in r.category_scores if c.category == "keywords"] == [False]
    assert strong.snapshot.experience_months == 127 - 1


def test_hard_wrapped_phrases_and_two_columns(spark, docs_of):
    text = STRONG_CV.replace("building payment systems", "with a proven\ntrack record")
    assert any(
        f.rule_id == "impact.cliches" and f.section == "summary"
        for f in corpus.score_corpus(docs_of(text), TODAY).first().findings
    )
    docs = docs_of("Kim Roe\nEXPERIENCE\nSKILLS\n- Built 3 tools for the team\n").withColumn(
        "layout", F.struct(F.lit(1).alias("multi_column_pages"))
    )
    ids = {f.rule_id for f in corpus.score_corpus(docs, TODAY).first().findings}
    assert {"ats.multi_column", "structure.empty_experience"} <= ids and "ats.clean_layout" not in ids


def test_own_rule_and_undecided_rule(docs_of):
    cat = ru.document_catalogue().register(
        ru.Rule("custom.short_name", "warning", 9, lambda v: F.length(v["contact"]["name"]) < 20, category="contact")
    ).register(ru.Rule("custom.broken", "critical", 50, lambda v: F.try_divide(F.lit(1), F.lit(0)) > 1, category="ats"))
    r = corpus.score_corpus(docs_of(STRONG_CV), TODAY, catalogue=cat).first()
    assert "custom.short_name" in {f.rule_id for f in r.findings}
    assert r.rule_errors == ["custom.broken"] and r.overall > 0


def _exploding_catalogue():
    """The catalogue with rules that raise errors, each in another part."""
    zero = lambda v: F.lit(1) / (F.size(v["contact"]["emails"]) - F.size(v["contact"]["emails"]))
    name = lambda v: v["contact"]["name"]
    cat = ru.document_catalogue()
    for rule in (
        ru.Rule("custom.divides", "critical", 50, lambda v: zero(v) > 1, category="ats"),
        ru.Rule("custom.casts", "warning", lambda v: name(v).cast("int"), lambda v: F.lit(True), category="impact"),
        ru.Rule("custom.raises", "warning", 3, lambda v: F.lit(True), lambda v: F.array(F.raise_error(name(v)).cast("string")), category="impact"),
        ru.Rule("custom.sound", "suggestion", 2, lambda v: F.coalesce(F.length(name(v)), F.lit(0)) >= 0, category="contact"),
    ):
        cat = cat.register(rule)
    return cat


def test_a_rule_that_raises_fails_alone(docs_of):
    docs = docs_of(STRONG_CV, WEAK_CV, "1234\nnothing else here")
    plain = {r.doc_id: r for r in corpus.score_corpus(docs, TODAY).collect()}
    reviews = corpus.score_corpus(docs, TODAY, catalogue=_exploding_catalogue())
    got = {r.doc_id: r for r in reviews.collect()}
    assert got[0].rule_errors == ["custom.divides", "custom.casts", "custom.raises"]
    for i, r in got.items():
        others = [f for f in r.findings if not f.rule_id.startswith("custom.")]
        assert others == plain[i].findings and "custom.sound" in {f.rule_id for f in r.findings}
    rows = {(r.doc_id, r.rule_id) for r in corpus.errors_table(reviews, "doc_id").collect()}
    assert {(0, "custom.casts"), (1, "custom.divides"), (2, "custom.raises")} <= rows
    assert not any(rule == "custom.sound" for _, rule in rows)


def test_an_unguarded_rule_ends_the_job(docs_of):
    broken = ru.Rule("custom.raises", "warning", 3, lambda v: F.raise_error(F.lit("boom")).cast("boolean"), category="ats")
    cat = ru.document_catalogue().register(broken, guarded=False)
    with pytest.raises(Exception, match="boom"):
        corpus.score_corpus(docs_of(STRONG_CV), TODAY, catalogue=cat).collect()


def test_failed_documents_are_stored_as_failed(spark, docs_of, tmp_path):
    from vitalens.sources import sinks

    whole = ru.Rule("custom.raises", "warning", 3, lambda v: F.when(v["contact"]["name"] == "Dana Whitfield", F.raise_error(F.lit("boom")).cast("boolean")), category="ats")
    cat = ru.document_catalogue().register(whole, guarded=False)
    docs = docs_of(STRONG_CV, WEAK_CV, None)
    reviews = corpus.score_corpus(docs, TODAY, catalogue=cat, guarded=True)
    sinks.write_reviews(reviews, str(tmp_path), TODAY, run_id="r")
    stored = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/reviews").collect()}
    assert {i: r.status for i, r in stored.items()} == {0: "failed", 1: "complete", 2: "failed"}
    assert all((r.overall is None) == (r.band is None) == (r.error is not None) == (r.status == "failed") for r in stored.values())
    for child in ("findings", "category_scores", "priorities"):
        assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/{child}").collect()} == {1}
    assert stored[1].overall == corpus.score_corpus(docs, TODAY).filter("doc_id = 1").first().overall


def test_whole_word_option(spark):
    df = spark.createDataFrame([("photography and photo.",), ("photography",)], "t string")
    hits = [r.h for r in df.select(ft.phrase_hits(F.col("t"), ["photo"], word_boundary=True).alias("h")).collect()]
    assert hits == [["photo"], []]


def test_every_rule_fires_on_the_career_documents(spark):
    from vitalens.sources import tables as tb

    docs = tb.cv_docs(spark, "/root/testdata/sf0.01")
    found = ru.document_findings(ft.profile(docs, tb.TODAY))
    fired = {r.rule_id for r in found.select(F.explode_outer("findings.rule_id").alias("rule_id")).distinct().collect()}
    assert {r.rule_id for r in ru.document_catalogue().rules} - fired == set()


def test_evidence_spans(spark):
    rows = [
        (
            1,
            "Led the team. led the TEAM player\nteam player",
            [
                ("a", "warning", ["team player"]), ("b", "warning", ["Led the team"]),
                ("c", "positive", ["player"]), ("d", "critical", ["the", "player\nteam"]),
            ],
        ),
        (2, "nothing here", []),
        (3, "abcdabcd", [("x", "warning", ["abcd"])]),
    ]
    schema = "doc_id bigint, text string, findings array<struct<rule_id:string,severity:string,evidence:array<string>>>"
    marked = an.annotate(spark.createDataFrame(rows, schema)).collect()
    spans = {r.doc_id: [(s.start, s.end, s.rule_id) for s in r.spans] for r in marked}
    # "Led the team" (12) claims first, then "team player" (11) and "player\nteam" (11) in finding order.
    assert spans[1] == [(0, 12, "b"), (14, 26, "b"), (34, 45, "a")]
    assert spans[2] == [] and spans[3] == [(0, 8, "x")]
    cut = an.annotate(spark.createDataFrame([(1, "ab\ncd ef", [("r", "warning", ["b\ncd"])])], schema)).first()
    assert [(r.line_no, r.start, r.end) for r in cut.runs] == [(0, 1, 2), (1, 0, 2)]


def test_sections_are_counted_only_where_counts_are_read(spark, docs_of):
    for table in (fx.bullets_table, fx.date_ranges_table, fx.contacts_table):
        plan = table(docs_of("Experience\n- Built it in 1999 - 2001"))._jdf.queryExecution().optimizedPlan().toString()
        assert "AS word_count" not in plan and "word_count," not in plan


def test_pronouns_are_whole_tokens(spark):
    import random
    import re

    r = random.Random(3)
    texts = ["i'm my 'my' ''we a'my my'", "", None] + ["".join(r.choice(["my", "we", "i", "'", " ", ".", "é", "ours", "_", "-"]) for _ in range(40)) for _ in range(200)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", ft.pronoun_hits(F.col("t")).alias("p")).collect()
    for row in got:
        want = None if row.t is None else [w for w in re.findall(r"\w[\w']*", row.t) if w in lx.FIRST_PERSON]
        assert row.p == want


def test_long_lines_name_no_section(spark):
    lines = ["Work / Experience & Projects", "--- Skills and Tools ---", "One two three four five Skills", "One two three four five six Skills", "A/B/C/D/E/ Skills", "Skills - - - - - -", "É È Ê Ë Skills", "A B C D E (Skills)"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("t", sx.heading_name(F.col("t")).alias("n"), sx.normalise_heading(F.col("t")).alias("norm")).collect()
    for row in got:
        assert row.n is None or len(row.norm.split(" ")) <= 5
    assert [r.n for r in got if r.t in ("--- Skills and Tools ---", "Skills - - - - - -", "É È Ê Ë Skills")] == ["skills"] * 3
