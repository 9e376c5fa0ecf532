"""Shape of the physical plans, and streaming end to end."""

from conftest import STRONG_CV, TODAY, WEAK_CV
from pyspark.sql import functions as F

from vitalens.operators import history as hs
from vitalens.operators import rules as ru
from vitalens.plans import corpus
from vitalens.sources import sinks
from vitalens.sources import tables as tb
from vitalens.streaming import scoring

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_one_map_stage(spark):
    docs = tb.table(spark, SF, "documents").select("doc_id", "text")
    plan = plan_of(corpus.findings_table(corpus.score_corpus(docs, TODAY), "doc_id"))
    assert "Exchange" not in plan and "Python" not in plan
    assert "struct<doc_id:bigint,text:string>" in plan


def test_key_filter_reaches_the_scan(spark):
    plan = plan_of(tb.ev_reviews(spark, SF).filter(F.col("review_id") == 7))
    assert "EqualTo(event_id,7)" in plan


def test_top_per_key_limits_before_the_shuffle(spark):
    plan = plan_of(hs.within_quota(tb.ev_docs(spark, SF).withColumn("created_at", F.current_timestamp())))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_history_page_is_a_top_k(spark):
    plan = plan_of(hs.history(tb.ev_reviews(spark, SF), tb.ev_docs(spark, SF), "1"))
    assert "TakeOrderedAndProject" in plan


def test_partitioning_does_not_change_results(docs_of):
    docs = docs_of(STRONG_CV, WEAK_CV, "x", "")
    runs = [
        sorted((r.doc_id, r.overall, [tuple(f) for f in r.findings]) for r in corpus.score_corpus(d, TODAY).collect())
        for d in (docs.repartition(1), docs.repartition(7), docs.orderBy(F.col("doc_id").desc()))
    ]
    assert str(runs[0]) == str(runs[1]) == str(runs[2])


def test_stored_reviews_can_be_read_back(spark, docs_of, tmp_path):
    reviews = corpus.score_corpus(docs_of(STRONG_CV, WEAK_CV), TODAY)
    sinks.write_reviews(reviews, str(tmp_path), TODAY, run_id="first")
    sinks.write_reviews(reviews, str(tmp_path), TODAY, run_id="first")  # a repeat replaces its run
    assert spark.read.parquet(str(tmp_path / "reviews")).count() == 2
    assert spark.read.parquet(str(tmp_path / "category_scores")).count() == 12
    stored = spark.read.parquet(str(tmp_path / "findings"))
    assert stored.count() == reviews.select(F.sum(F.size("findings"))).first()[0]
    assert {str(r.review_date) for r in stored.select("review_date").distinct().collect()} == {str(TODAY)}


def test_runs_of_one_day_are_both_kept(spark, docs_of, tmp_path):
    for text in (STRONG_CV, WEAK_CV):
        sinks.write_reviews(corpus.score_corpus(docs_of(text), TODAY), str(tmp_path), TODAY)
    assert spark.read.parquet(str(tmp_path / "reviews")).count() == 2
    assert spark.read.parquet(str(tmp_path / "category_scores")).count() == 12


def test_streamed_uploads_equal_batch(spark, docs_of, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a.txt": STRONG_CV, "b.txt": WEAK_CV}.items():
        (tmp_path / "in" / name).write_text(text)
    (tmp_path / "in" / "c.doc").write_bytes(b"x" * 300)
    files = scoring.read_uploads(spark, str(tmp_path / "in"))
    q = scoring.score_uploads(files, str(tmp_path / "out"), str(tmp_path / "cp"), TODAY)
    q.awaitTermination(180)
    got = sorted(r.overall for r in spark.read.parquet(str(tmp_path / "out" / "reviews")).collect())
    want = sorted(r.overall for r in corpus.score_corpus(docs_of(STRONG_CV, WEAK_CV), TODAY).collect())
    assert got == want
    rejected = sinks.read_uploads(spark, str(tmp_path / "out")).filter("not accepted").collect()
    assert [r.reject_reason for r in rejected] == ["legacy_format"]


def test_catalogue_ids_are_unique():
    ids = [r.rule_id for c in (ru.document_catalogue(), ru.keyword_catalogue()) for r in c.rules]
    assert len(ids) == len(set(ids)) == 66


def test_what_a_query_does_not_read_is_not_evaluated(spark, docs_of):
    from vitalens.operators import facts as fx
    from vitalens.operators import features as ft

    docs = docs_of(STRONG_CV, WEAK_CV)
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    name = optimized(fx.contacts_table(docs).select("doc_id", "name"))
    assert "github" not in name and "passport" not in name
    phrases = optimized(ft.profile(docs, TODAY).select("doc_id", "fillers", "cliches", "pronouns"))
    assert "professional summary" not in phrases and "thousand" not in phrases
    opener = optimized(ft.profile(docs, TODAY).select("doc_id", "top_opener.*"))
    assert "thousand" not in opener and "tasked with" not in opener
    assert "regexp_extract_all" not in optimized(ft.profile(docs, TODAY).select("layout.word_count"))


def test_impact_holds_what_its_columns_hold(docs_of):
    from vitalens.operators import features as ft

    for r in ft.profile(docs_of(STRONG_CV, WEAK_CV, ""), TODAY).collect():
        assert (r.impact.top_opener, r.impact.fillers, r.impact.cliches, r.impact.pronouns) == (r.top_opener, r.fillers, r.cliches, r.pronouns)
        assert tuple(r.impact.__fields__) == ft.IMPACT and r.impact.bullets == len(r.judged)


def test_documents_are_read_once_for_all_career_documents(spark):
    """Letters are taken of a document, not again of each customer that shares it, and texts are joined last."""
    import re

    plan = tb.cv_docs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, below = re.split(r"Join [^\n]*doc_key", plan, maxsplit=1)
    assert "regexp_replace" not in above and "Join " not in above and below.count("regexp_replace(text") == 1


def test_dates_are_tried_at_digits_and_months_only():
    import re

    from vitalens import lexicon as lx
    from vitalens.operators import facts as fx

    start = re.search(r"\(\?=\[([^\]]*)\]\)", fx.DATE_RANGE).group(1)
    assert all(re.match(f"[{start}]", x) for x in [*lx.MONTHS, *"0123456789"]) and not re.match(f"[{start}]", "b")


def test_snapshot_counts_each_word_once_and_no_words_of_bullets(spark, docs_of):
    from vitalens.functions import text as tx
    from vitalens.operators import facts as fx
    from vitalens.operators import features as ft

    docs = docs_of(STRONG_CV, WEAK_CV, "", "a b's  c-d\n\nSKILLS\n\nx\n\n \nEDUCATION:\ny _z")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = corpus.review_documents(docs, TODAY).select("snapshot")._jdf.queryExecution().optimizedPlan().toString()
    assert fx.FIRST_WORD not in plan and "regexp_replace(concat(text" not in plan
    found = ft.profile(docs, TODAY).withColumn("words", tx.word_count(F.col("text")))
    for r in found.select("words", "layout", "sized", "bullets", "bullet_lines").collect():
        assert r.layout == r.sized and r.sized.word_count == r.words and len(r.bullets) == len(r.bullet_lines)


def test_headings_and_dates_make_no_arrays_and_no_failing_casts(spark, docs_of):
    from vitalens.operators import facts as fx
    from vitalens.operators import sections as sx

    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = docs_of("EXPERIENCE\nDev | Sept. 1999 - Mar 2004\nDev | 03/2004 to 13/2005\nDev | 2006 - Present\nONE TWO THREE FOUR FIVE\nONE TWO THREE FOUR FIVE SIX")
    assert "regexp_extract_all" not in optimized(sx.dominant_styles(docs))
    ranges = fx.date_ranges_table(docs)
    assert "try_to_number" not in optimized(ranges) and "try_cast" not in optimized(ranges)
    got = [tuple(r)[-5:] for r in ranges.orderBy("range_no").collect()]
    assert got == [(1999, 9, 2004, 3, False), (2004, 3, 2005, None, False), (2006, None, None, None, True)]
    styles = {r.heading: r.style for r in sx.match_headings(docs).collect()}
    assert styles["ONE TWO THREE FOUR FIVE"] == "caps" and "ONE TWO THREE FOUR FIVE SIX" not in styles


def test_rules_of_one_category_read_what_they_need(spark, docs_of):
    from vitalens.operators import features as ft

    docs = docs_of(STRONG_CV, WEAK_CV, "", "x").union(spark.createDataFrame([(9, None)], "doc_id bigint, text string"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    own = ru.Rule("structure.own", "warning", 1, lambda v: v["impact"]["bullets"] > 0)
    catalogue = ru.document_catalogue().register(own)
    found = ru.document_findings(ft.profile(docs.filter("text IS NOT NULL"), TODAY), catalogue)
    contact, structure = optimized(found.select("contact_findings")), optimized(ru.document_findings(ft.profile(docs, TODAY)).select("structure_findings"))
    assert "structure.complete" not in contact and "tasked with" not in contact and "thousand" not in contact
    assert "contact.complete" not in structure and "thousand" not in structure
    for r in found.collect():
        held = [f for c in ("contact", "structure", "impact", "ats", "formatting") for f in r[f"{c}_findings"]]
        key = lambda f: (f.rule_id, f.category, f.severity, f.penalty, tuple(f.evidence))
        assert sorted(map(key, held)) == sorted(map(key, r.findings)) and not any(f.section for f in held)
        assert ("structure.own" in {f.rule_id for f in r.structure_findings}) == (r.impact.bullets > 0)
    reviewed = corpus.review_documents(docs, TODAY)
    assert "tasked with" not in optimized(reviewed.select("ats_findings", "structure_findings"))
    assert [r.ats_findings for r in reviewed.filter("doc_id = 9").collect()] == [None]
    assert not [c for c in corpus.score_corpus(docs, TODAY).columns if c.endswith("_findings")]
