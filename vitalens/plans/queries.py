"""Every operator bound to the given tables: name -> (spark, sf_dir) -> DataFrame.

Arrays are rendered as text so that results compare across engines.
"""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalens import lexicon as lx
from vitalens.functions import terms as tm
from vitalens.functions import text as tx
from vitalens.functions.core import built_once, round1, unnest
from vitalens.operators import annotate as an
from vitalens.operators import best as bs
from vitalens.operators import comparison as cm
from vitalens.operators import facts as fx
from vitalens.operators import features as ft
from vitalens.operators import history as hs
from vitalens.operators import layout as ly
from vitalens.operators import matching as mt
from vitalens.operators import reports as rp
from vitalens.operators import rules as ru
from vitalens.operators import scoring as sc
from vitalens.operators import sections as sx
from vitalens.operators import timeline as tl
from vitalens.plans import corpus
from vitalens.session import checkpoint_folder, checkpointed
from vitalens.sources import ingest, sinks
from vitalens.sources import tables as tb
from vitalens.streaming import throttle as th
from vitalens.streaming import uploads as up

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def joined(items: Column | str) -> Column:
    return F.array_join(items, " ~ ")


# --- sections ----------------------------------------------------------------------------


@query("x1_heading_normalise")
def _(spark, d):
    lines = sx.lines_table(tb.cv_docs(spark, d))
    return lines.filter(~tx.is_blank(F.col("line"))).select(
        "doc_id", "line_no", sx.normalise_heading(tx.ustrip(F.col("line"))).alias("norm")
    )


@query("x2_heading_match")
def _(spark, d):
    heads = sx.match_headings(tb.cv_docs(spark, d))
    return heads.filter(F.col("name").isNotNull()).select("doc_id", "line_no", "heading", "name")


@query("x3_heading_style")
def _(spark, d):
    heads = sx.match_headings(tb.cv_docs(spark, d))
    return heads.filter(F.col("style").isNotNull()).select("doc_id", "line_no", "style")


@query("x4_dominant_style")
def _(spark, d):
    return sx.dominant_styles(tb.cv_docs(spark, d))


@query("x5_sections")
def _(spark, d):
    return sx.sections_table(tb.cv_docs(spark, d)).select(
        "doc_id", "sec_no", "name", "heading", "start_line", "end_line", F.md5("text").alias("body"), "word_count"
    )


@query("x6_largest_section")
def _(spark, d):
    return sx.largest_sections(tb.cv_docs(spark, d))


@query("x7_section_presence")
def _(spark, d):
    secs = fx.parse(tb.cv_docs(spark, d))
    return secs.select(
        "doc_id",
        *[sx.has_section(F.col("secs"), n).alias(f"has_{n}") for n in ("experience", "skills", "summary")],
        joined(F.array_sort(F.array_distinct(sx.recognised_names(F.col("secs"))))).alias("names"),
    )


# --- facts -----------------------------------------------------------------------------------


def _contacts(spark, d, *cols) -> DataFrame:
    return fx.contacts_table(tb.cv_docs(spark, d)).select("doc_id", *cols)


@query("x8_contact_scope")
def _(spark, d):
    docs = fx.parse(tb.cv_docs(spark, d)).withColumn("header", fx.header_of(F.col("text"), F.col("secs")))
    return docs.select("doc_id", F.md5("header").alias("header"), fx.header_has_email(F.col("header")).alias("header_only"))


@query("x9_emails")
def _(spark, d):
    return _contacts(spark, d, joined("emails").alias("emails"))


@query("x10_phones")
def _(spark, d):
    return _contacts(spark, d, joined("phones").alias("phones"))


@query("x11_links")
def _(spark, d):
    return _contacts(spark, d, "linkedin", "github", joined("websites").alias("websites"))


@query("x12_name")
def _(spark, d):
    return _contacts(spark, d, "name")


@query("x13_location")
def _(spark, d):
    return _contacts(spark, d, "location")


@query("x14_sensitive_terms")
def _(spark, d):
    return _contacts(spark, d, joined("sensitive").alias("sensitive"))


@query("x15_x16_bullets")
def _(spark, d):
    return fx.bullets_table(tb.cv_docs(spark, d))


@query("x17_x18_date_ranges")
def _(spark, d):
    return fx.date_ranges_table(tb.cv_docs(spark, d))


@query("x19_j4_range_sections")
def _(spark, d):
    ranges = fx.date_ranges_table(tb.cv_docs(spark, d))
    return ranges.select("doc_id", "range_no", "line_no", "section", "raw", "is_current")


@query("x20_work_ranges")
def _(spark, d):
    docs = fx.parse(tb.cv_docs(spark, d))
    return unnest(docs, ["doc_id"], fx.work_ranges(F.col("ranges"))).select(
        "doc_id", "line_no", "section", "raw"
    )


@query("x21_judged_bullets")
def _(spark, d):
    docs = fx.parse(tb.cv_docs(spark, d))
    return unnest(docs, ["doc_id"], fx.judged_bullets(F.col("bullets"))).select(
        "doc_id", "line_no", "section"
    )


# --- timeline -----------------------------------------------------------------------------------


@query("tl1_month_ordinals")
def _(spark, d):
    return tl.spans_table(tb.cv_docs(spark, d), tb.TODAY)


@query("tl2_w4_gaps")
def _(spark, d):
    return tl.gaps_table(tb.cv_docs(spark, d), tb.TODAY)


@query("tl3_tl4_tl5_tenure")
def _(spark, d):
    return tl.tenure(tb.cv_docs(spark, d), tb.TODAY)


# --- features ---------------------------------------------------------------------------------------


@built_once
def _judged() -> Column:
    return ft.judge(fx.judged_bullets(F.col("bullets")))


@query("fe1_fe2_bullet_flags")
def _(spark, d):
    docs = fx.parse(tb.cv_docs(spark, d))
    return unnest(docs, ["doc_id"], _judged()).select(
        "doc_id", "line_no", "quantified", "weak", "strong"
    )


@query("fe3_verb_hint")
def _(spark, d):
    bullets = fx.bullets_table(tb.cv_docs(spark, d))
    return bullets.select("doc_id", "line_no", ft.verb_hint(F.col("body")).alias("hint"))


@query("fe4_top_opener")
def _(spark, d):
    return ft.profile(tb.cv_docs(spark, d), tb.TODAY).select("doc_id", "top_opener.*").select(
        "doc_id", "opener", "n"
    )


@query("fe5_fe6_phrase_hits")
def _(spark, d):
    return ft.profile(tb.cv_docs(spark, d), tb.TODAY).select(
        "doc_id",
        joined("fillers").alias("fillers"),
        joined("cliches").alias("cliches"),
        F.col("pronouns.n").alias("pronouns"),
        joined("pronouns.sample").alias("pronoun_sample"),
    )


@query("w6_first_n_evidence")
def _(spark, d):
    return ft.profile(tb.cv_docs(spark, d), tb.TODAY).select(
        "doc_id",
        joined("judging.unquantified_bodies").alias("unquantified"),
        joined("judging.weak_bodies").alias("weak"),
        F.col("judging.tense_sample").alias("tense_sample"),
        F.col("judging.past").alias("past"),
        F.col("judging.gerund").alias("gerund"),
    )


# --- rules and scores ---------------------------------------------------------------------------------


def _findings(spark, d) -> DataFrame:
    return corpus.findings_table(sc.score(corpus.review_documents(tb.cv_docs(spark, d), tb.TODAY)), "doc_id")


def _rule_query(category: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = ru.document_findings(ft.profile(tb.cv_docs(spark, d), tb.TODAY))
        return (
            unnest(found, ["doc_id"], f"{category}_findings")
            .filter(F.col("category") == category)
            .select("doc_id", "rule_id", "severity", "penalty", joined("evidence").alias("evidence"))
        )

    return run


for _category in ("contact", "structure", "impact", "ats", "formatting"):
    QUERIES[f"rules_{_category}"] = _rule_query(_category)


@query("fe9_section_attribution")
def _(spark, d):
    found = ru.document_findings(ft.profile(tb.cv_docs(spark, d), tb.TODAY))
    return unnest(found, ["doc_id"], "findings").select("doc_id", "rule_id", "section")


@query("s1_finding_order")
def _(spark, d):
    return _findings(spark, d).select("doc_id", "finding_no", "rule_id")


@query("ag1_category_scores")
def _(spark, d):
    reviews = corpus.score_corpus(tb.cv_docs(spark, d), tb.TODAY)
    return corpus.category_table(reviews, "doc_id")


@query("ag2_ag3_overall")
def _(spark, d):
    return corpus.score_corpus(tb.cv_docs(spark, d), tb.TODAY).select("doc_id", "overall", "band")


@query("ag4_s2_priorities")
def _(spark, d):
    reviews = corpus.score_corpus(tb.cv_docs(spark, d), tb.TODAY)
    return corpus.priority_table(reviews, "doc_id").select("doc_id", "rank", "rule_id", "penalty", "overall_gain")


@query("ag4_f9_projection")
def _(spark, d):
    return corpus.score_corpus(tb.cv_docs(spark, d), tb.TODAY).select(
        "doc_id",
        round1(F.col("overall")).alias("overall"),
        "projected_score",
        (F.col("projected_score") > F.col("overall") + 0.5).alias("show_projection"),
    )


@query("ag5_snapshot")
def _(spark, d):
    return corpus.review_documents(tb.cv_docs(spark, d), tb.TODAY).select(
        "doc_id",
        joined("snapshot.detected_sections").alias("detected_sections"),
        joined(F.transform("snapshot.sections", lambda s: F.concat(s["name"], F.lit(":"), s["word_count"].cast("string")))).alias("sections"),
        *[
            F.col(f"snapshot.{n}").alias(n)
            for n in (
                "bullet_count", "range_count", "gap_count", "experience_months", "experience_years",
                "word_count", "page_count",
            )
        ],
    )


# --- keyword matching --------------------------------------------------------------------------------


def doc_requests(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Two postings per document, spread over all postings (numbered from 0)."""
    n_postings = postings.agg(F.count("*")).scalar()
    ids = F.array(F.col("doc_id") % n_postings, (F.col("doc_id") * 7 + 3) % n_postings)
    return docs.select("doc_id", F.explode(F.array_distinct(ids)).alias("posting_id"))


def _cv_requests(spark, d) -> DataFrame:
    """Each posting asked for by a document and each document asking for a posting (both numbered from 0)."""
    docs = tb.table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("doc_id"))
    postings = tb.table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("posting_id"))
    n_docs, n_postings = (t.agg(F.count("*")).scalar() for t in (docs, postings))
    asked = postings.select((F.col("posting_id") % n_docs).alias("doc_id"), "posting_id")
    asking = docs.select("doc_id", ((F.col("doc_id") * 7 + 3) % n_postings).alias("posting_id"))
    return asked.unionByName(asking).distinct()


@query("k1_k2_tokens")
def _(spark, d):
    lines = sx.lines_table(tb.documents(spark, d))
    chunks = lines.select("doc_id", "line_no", F.posexplode(tm.chunks_of(F.col("line"))).alias("chunk_no", "tokens"))
    return chunks.select("doc_id", "line_no", "chunk_no", F.array_join("tokens", " ").alias("tokens"))


@query("k3_noise_filter")
def _(spark, d):
    docs = tb.documents(spark, d)
    tokens = docs.select(F.explode(F.flatten(tm.text_chunks(F.col("text")))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return counts.filter(~tm.is_noise(F.col("token")))


@query("k4_stem")
def _(spark, d):
    docs = tb.documents(spark, d)
    tokens = docs.select(F.explode(F.array_distinct(F.flatten(tm.text_chunks(F.col("text"))))).alias("token"))
    return tokens.distinct().select("token", tm.stem(F.col("token")).alias("stem"))


@query("k5_line_weight")
def _(spark, d):
    lines = mt.candidate_lines(tb.cv_postings(spark, d))
    return lines.select("posting_id", "line_no", F.col("line_weight").cast("double").alias("line_weight"))


@query("k6_k7_candidate_terms")
def _(spark, d):
    both = tb.postings(spark, d).select((-1 - F.col("posting_id")).alias("posting_id"), "text").unionByName(
        tb.cv_postings(spark, d)
    )
    return mt.candidate_terms(both).select("posting_id", "key", "term", F.col("weight").cast("double").alias("weight"))


@query("k8_s5_posting_terms")
def _(spark, d):
    return mt.posting_terms(tb.postings(spark, d)).select(
        "posting_id", "rank", "key", "term", F.col("weight").cast("double").alias("weight")
    )


@query("k9_document_forms")
def _(spark, d):
    forms = mt.document_forms(tb.documents(spark, d))
    return forms.groupBy("form").agg(F.count("*").alias("n_docs"))


@query("k10_j3_term_match")
def _(spark, d):
    docs = tb.cv_docs(spark, d)
    terms = mt.posting_terms(tb.cv_postings(spark, d))
    long = mt.term_table(mt.match_terms(docs, terms, _cv_requests(spark, d)))
    return long.select(
        "doc_id", "posting_id", "rank", "term", F.col("weight").cast("double").alias("weight"),
        "in_doc", joined("variants").alias("variants"),
    )


@query("k11_coverage")
def _(spark, d):
    docs = tb.documents(spark, d)
    report = mt.match_report(docs, tb.postings(spark, d), doc_requests(docs, tb.postings(spark, d)))
    return report.select(
        "doc_id", "posting_id", "coverage", "matched_count", "total_count",
        joined(F.transform(F.slice("missing", 1, 8), lambda t: t["term"])).alias("top_missing"),
    )


@query("k12_best_postings")
def _(spark, d):
    return bs.best_matches(tb.cv_docs(spark, d), tb.cv_postings(spark, d), 5)


@query("k12_best_documents")
def _(spark, d):
    return bs.best_matches(tb.documents(spark, d), tb.postings(spark, d), 10, per="posting_id")


def _matched_reviews(spark, d) -> DataFrame:
    docs = tb.cv_docs(spark, d)
    requests = _cv_requests(spark, d)
    matches = mt.match_report(docs, tb.cv_postings(spark, d), requests)
    return corpus.score_corpus(docs, tb.TODAY, matches, requests)


@query("rules_keywords")
def _(spark, d):
    return corpus.findings_table(_matched_reviews(spark, d), "doc_id", "posting_id").filter(
        F.col("category") == "keywords"
    ).select("doc_id", "posting_id", "rule_id", "severity", "penalty", joined("evidence").alias("evidence"), "section")


@query("ag2_overall_with_posting")
def _(spark, d):
    return _matched_reviews(spark, d).select("doc_id", "posting_id", "overall", "band", "projected_score")


# --- stored reviews ------------------------------------------------------------------------------------


def _daily_scores(spark, d) -> DataFrame:
    findings = tb.ev_findings(spark, d)
    days = tb.ev_days(spark, d).select("review_id")
    names = F.array(*[F.lit(c) for c, _ in lx.CATEGORY_WEIGHTS])
    applicable = days.select("review_id", F.explode(names).alias("category")).filter(
        F.col("category") != "keywords"
    )
    return sc.score_long_findings(findings, applicable).withColumn("applicable", F.lit(True))


def _ordered_findings(spark, d) -> DataFrame:
    """Daily findings numbered in report order; a review holds at most one finding per rule."""
    w = Window.partitionBy("review_id").orderBy(
        sc.severity_rank(F.col("severity")), -F.col("penalty"), "category", "rule_id"
    )
    return tb.ev_findings(spark, d).withColumn("finding_no", F.row_number().over(w))


@query("ag6_owner_stats")
def _(spark, d):
    return hs.owner_stats(tb.ev_reviews(spark, d), tb.ev_docs(spark, d))


@query("ag7_review_counts")
def _(spark, d):
    return hs.review_counts(tb.ev_reviews(spark, d))


@query("j2_decorated_documents")
def _(spark, d):
    return hs.decorate(tb.ev_docs(spark, d), tb.ev_reviews(spark, d)).select(
        "doc_id", "filename", "review_count", "latest_score"
    )


@query("w1_latest_score")
def _(spark, d):
    return hs.latest_scores(tb.ev_reviews(spark, d))


@query("w2_document_deltas")
def _(spark, d):
    return hs.document_deltas(tb.ev_reviews(spark, d)).select("review_id", "doc_id", "delta")


@query("w3_owner_deltas")
def _(spark, d):
    return hs.owner_deltas(tb.ev_reviews(spark, d))


@query("w8_trend")
def _(spark, d):
    return hs.trend(tb.ev_reviews(spark, d)).select("owner_id", "review_id", "score", "position")


@query("j1_f5_summaries")
def _(spark, d):
    reviews = hs.with_filename(tb.ev_reviews(spark, d), tb.ev_docs(spark, d))
    return hs.summaries(reviews, "filename").drop("created_at")


@query("s3_history_page")
def _(spark, d):
    page = hs.history(tb.ev_reviews(spark, d), tb.ev_docs(spark, d), owner="7", limit=25, offset=10)
    return page.select("review_id", "doc_id", "filename", "overall")


@query("f1_f3_owner_document")
def _(spark, d):
    return hs.of_document(hs.owned(tb.ev_reviews(spark, d), "8"), "8-1").select("review_id", "status", "overall")


@query("f2_f4_complete_in_list")
def _(spark, d):
    wanted = tb.ev_docs(spark, d).filter(F.col("filename").like("upload-1%"))
    return hs.of_documents(hs.completed(tb.ev_reviews(spark, d)), wanted).groupBy("doc_id").agg(
        F.count("*").alias("n")
    )


@query("src7_key_scan")
def _(spark, d):
    return tb.ev_reviews(spark, d).filter(F.col("review_id") == 1234).select("review_id", "owner_id", "overall")


@query("f10_score_colour")
def _(spark, d):
    return tb.ev_reviews(spark, d).select("review_id", hs.score_colour(F.col("overall")).alias("colour"))


@query("s4_sorted_history")
def _(spark, d):
    top = hs.sort_history(hs.owned(hs.completed(tb.ev_reviews(spark, d)), "3"), "highest")
    return top.select("review_id", "overall")


@query("s7_documents_newest_first")
def _(spark, d):
    return hs.documents_newest_first(tb.ev_docs(spark, d), "5").select("doc_id", "filename")


@query("src5_quota")
def _(spark, d):
    uploads = tb.ev_reviews(spark, d).select(
        "owner_id", F.col("review_id").alias("doc_id"), "created_at"
    )
    return hs.within_quota(uploads).select("owner_id", "doc_id", "accepted")


@query("src6_stored_layout")
def _(spark, d):
    stored = tb.table(spark, d, "events").select("event_id", "props", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return ingest.stored_layout(stored, "props").select("event_id", "k", "table_count", "is_scanned")


@query("j5_baselines")
def _(spark, d):
    return hs.baselines(tb.ev_reviews(spark, d))


@query("j6_explicit_baselines")
def _(spark, d):
    reviews = tb.ev_reviews(spark, d)
    pairs = reviews.select(
        "review_id",
        F.when(F.col("review_id") % 5 == 0, F.col("review_id"))
        .when(F.col("review_id") % 5 == 1, -F.col("review_id"))
        .otherwise(F.pmod(F.col("review_id") * 3, reviews.agg(F.count("*")).scalar()))
        .alias("baseline_id"),
    )
    return hs.check_pairs(pairs, reviews)


def _compared(spark, d) -> DataFrame:
    """Daily reviews, their findings and scores, stored as a sink would, and each compared with its baseline."""
    days, findings, scores = (checkpointed(t) for t in (tb.ev_days(spark, d), tb.ev_findings(spark, d), _daily_scores(spark, d)))
    bits = cm.RuleBits(tb.EV_RULES)
    pairs = hs.baselines(days).filter(F.col("baseline_id").isNotNull())
    return cm.compare(pairs, cm.review_cards(days, findings, scores, bits), bits)


@query("j7_finding_diff")
def _(spark, d):
    return cm.finding_diff(_compared(spark, d))


@query("j8_category_deltas")
def _(spark, d):
    return cm.category_deltas(_compared(spark, d))


@query("compare_reviews")
def _(spark, d):
    out = _compared(spark, d)
    listed = lambda c: joined(F.transform(c, lambda r: F.concat_ws(":", r["rule_id"], r["severity"])))
    return out.select(
        "review_id", "baseline_id", "overall_delta", F.size("categories").alias("n_categories"),
        listed("resolved").alias("resolved"), listed("introduced").alias("introduced"), F.size("still_open").alias("still_open"),
    )


@query("j9_erasure")
def _(spark, d):
    """Rows left of each review in every stored table, once owners, documents and reviews are erased."""
    days = tb.ev_days(spark, d)
    erased = days.select(
        F.when(F.col("owner_id").endswith("3"), "owner").when(F.col("doc_id").endswith("8"), "document").otherwise("review").alias("kind"),
        F.when(F.col("owner_id").endswith("3"), F.col("owner_id")).when(F.col("doc_id").endswith("8"), F.col("doc_id")).otherwise(F.col("review_id")).alias("id"),
    ).filter((F.col("kind") != "review") | F.col("id").endswith("-05"))
    stored = {"reviews": days, "docs": tb.ev_docs(spark, d), "findings": tb.ev_findings(spark, d), "category_scores": _daily_scores(spark, d)}
    left = hs.erase(stored, erased)
    counts = [
        left[n].groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).withColumn("name", F.lit(n))
        for n, key in (("reviews", "review_id"), ("docs", "doc_id"), ("findings", "review_id"), ("category_scores", "review_id"))
    ]
    return functools.reduce(DataFrame.unionByName, counts)


@query("ag_cube")
def _(spark, d):
    dims = {"ai": F.col("ai_review").isNotNull(), "colour": hs.score_colour(F.col("overall")), "month": F.date_format("created_at", "yyyy-MM")}
    reviews = tb.ev_reviews(spark, d).withColumns(dims)
    exact = hs.completed(reviews).cube(*dims).agg(F.grouping_id().cast("int").alias("grouping_id"), F.count_distinct("doc_id").alias("exact"))
    same = functools.reduce(operator.and_, [F.col(f"c.{n}").eqNullSafe(F.col(f"x.{n}")) for n in (*dims, "grouping_id")])
    met = hs.review_cube(reviews, list(dims)).alias("c").join(exact.alias("x"), same)
    near = F.abs(F.col("documents") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * hs.SKETCH_ERROR * F.col("exact"))
    return met.select(*[f"c.{n}" for n in (*dims, "grouping_id")], "n", "best", round1(F.col("mean")).alias("mean"), near.alias("documents_near"))


@query("snk1_stored_reviews")
def _(spark, d):
    """Reviews as they are read back after being stored, with their child rows counted."""
    target = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    sinks.write_reviews(corpus.score_corpus(tb.cv_docs(spark, d), tb.TODAY), target, tb.TODAY, run_id="query")
    stored = {n: spark.read.parquet(f"{target}/{n}") for n in ("reviews", "findings", "category_scores", "priorities")}
    out = stored["reviews"].select("review_id", "doc_id", "status", "error", "overall", "band")
    for name, label in (("findings", "n_findings"), ("category_scores", "n_categories"), ("priorities", "n_priorities")):
        out = out.join(stored[name].groupBy("review_id").agg(F.count("*").alias(label)), "review_id", "left")
    return out.drop("review_id").fillna(0, ["n_findings", "n_categories", "n_priorities"])


@query("st3_distinct_uploads")
def _(spark, d):
    """Uploads (owner, fingerprint) of a stream over the events, repeats dropped."""
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    events = spark.readStream.schema(tb.table(spark, d, "events").schema).parquet(f"{d}/events[.]parquet")  # a stream takes no single file
    uploads = events.select(F.col("user_id").cast("string").alias("owner_id"), tx.fingerprint(F.col("props")).alias("text_hash"), F.col("ts").cast("timestamp").alias("ts"))
    kept = up.distinct_uploads_stream(uploads, "ts", "36500 days").select("owner_id", "text_hash")
    stream = kept.writeStream.format("parquet").option("path", f"{folder}/kept").option("checkpointLocation", f"{folder}/state")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{folder}/kept")


@query("st3_batch_uploads")
def _(spark, d):
    """The same rule on a table: at most one upload of an owner and text in 30 days."""
    uploads = tb.table(spark, d, "events").select(F.col("user_id").cast("string").alias("owner_id"), tx.fingerprint(F.col("props")).alias("text_hash"), "ts", "event_id")
    return up.distinct_uploads(uploads, "ts", "event_id", 30 * 86400).select("owner_id", "event_id")


@query("p10_role_fallback")
def _(spark, d):
    return hs.with_target_role(tb.ev_reviews(spark, d), tb.owners(spark, d)).select("review_id", "target_role")


@query("f6_severity_counts")
def _(spark, d):
    return hs.severity_counts(tb.ev_findings(spark, d))


@query("ag8_grouped_findings")
def _(spark, d):
    names = ["header", "summary", "experience", "education"]
    order = tb.ev_findings(spark, d).select("review_id").distinct().select(
        "review_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("sec_no", "section")
    )
    return hs.grouped_by_section(_ordered_findings(spark, d), order)


@query("ag9_findings_digest")
def _(spark, d):
    return hs.findings_digest(_ordered_findings(spark, d))


@query("f7_f8_layout_cause")
def _(spark, d):
    found = corpus.review_documents(tb.cv_docs(spark, d), tb.TODAY)
    # All of the findings that the cause can lie in.
    layout = F.concat("ats_findings", "structure_findings")
    return found.select(F.col("doc_id").alias("review_id"), hs.layout_cause(layout).alias("root_cause"))


@query("f7_applicable_categories")
def _(spark, d):
    cats = corpus.category_table(corpus.score_corpus(tb.cv_docs(spark, d), tb.TODAY), "doc_id")
    return cats.groupBy("category", "applicable").agg(F.count("*").alias("n"), F.sum("finding_count").alias("findings"))


# --- text preparation ------------------------------------------------------------------------------------


def _dirty(spark, d, fn) -> DataFrame:
    return tb.dirty_docs(spark, d).select("doc_id", F.md5(fn(F.col("text"))).alias("body"))


@query("p1_nfkc")
def _(spark, d):
    return tb.documents(spark, d).select("doc_id", F.md5(tx.nfkc(F.col("text"))).alias("body"))


@query("p2_glyph_map")
def _(spark, d):
    return _dirty(spark, d, tx.map_glyphs)


@query("p3_drop_control")
def _(spark, d):
    return _dirty(spark, d, tx.drop_control)


@query("p4_bullets")
def _(spark, d):
    return _dirty(spark, d, lambda t: tx.tidy_whitespace(tx.normalise_bullets(tx.strip_lines(tx.drop_control(t)))))


@query("p2_p5_clean")
def _(spark, d):
    return _dirty(spark, d, tx.clean_unnormalised)


@query("p6_p7_words_pages")
def _(spark, d):
    words = tx.word_count(F.col("text"))
    return tb.documents(spark, d).select("doc_id", words.alias("words"), tx.page_estimate(words).alias("pages"))


@query("p8_flat_text")
def _(spark, d):
    return _dirty(spark, d, tx.flatten_text)


@query("p9_tidy_input")
def _(spark, d):
    lines = sx.lines_table(tb.dirty_docs(spark, d))
    return lines.select("doc_id", "line_no", tx.tidy_input(F.col("line")).alias("tidy"))


@query("p11_truncate")
def _(spark, d):
    return tb.documents(spark, d).select("doc_id", F.md5(tx.truncate(F.col("text"), 2000)).alias("body"))


@query("p12_lines")
def _(spark, d):
    return sx.lines_table(tb.documents(spark, d)).select("doc_id", "line_no", F.length("line").alias("chars"))


@query("src3_near_empty")
def _(spark, d):
    return tb.documents(spark, d).filter(ingest.near_empty(F.col("text"))).select("doc_id")


@query("src1_src4_screen")
def _(spark, d):
    return ingest.screen(tb.files(spark, d)).select("path", "extension", "reject_reason")


@query("src2_decoding")
def _(spark, d):
    t, i = F.col("text"), F.col("doc_id") % 4
    content = (
        F.when(i == 0, F.encode(t, "UTF-16LE"))
        .when(i == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE")))
        .when(i == 2, F.encode(F.concat(t, F.lit("é")), "ISO-8859-1"))
        .otherwise(F.encode(t, "UTF-8"))
    )
    docs = tb.documents(spark, d).withColumn("content", content)
    named = docs.withColumn("codec", ingest.codec(F.col("content")))
    return named.select("doc_id", "codec", F.md5(ingest.decode(F.col("content"), F.col("codec"))).alias("body"))


@query("src8_fingerprint")
def _(spark, d):
    return tb.documents(spark, d).select("doc_id", tx.fingerprint(F.col("text")).alias("text_hash"))


@query("src8_repeated_uploads")
def _(spark, d):
    return ingest.repeated_uploads(tb.documents(spark, d))


@query("fe7_exotic_characters")
def _(spark, d):
    out = tb.dirty_docs(spark, d).select("doc_id", ft.exotic_characters(F.col("text")).alias("x"))
    return out.select("doc_id", F.col("x.n").alias("n"), F.col("x.sample").alias("sample"))


@query("fe8_line_stats")
def _(spark, d):
    return tb.documents(spark, d).select("doc_id", ft.line_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("documents_length_rules")
def _(spark, d):
    """Findings of the whole catalogue on documents of plain text."""
    docs = ingest.clean_documents(tb.documents(spark, d))
    found = ru.document_findings(ft.profile(docs, tb.TODAY))
    return unnest(found, ["doc_id"], "findings").select("doc_id", "rule_id", "severity", "penalty")


# --- layout ---------------------------------------------------------------------------------------------------


@query("x22_two_column_pages")
def _(spark, d):
    return ly.two_column_pages(tb.word_boxes(spark, d))


@query("x22_multi_column_counts")
def _(spark, d):
    return ly.multi_column_counts(tb.word_boxes(spark, d))


@query("x23_scanned")
def _(spark, d):
    return tb.documents(spark, d).select(
        "doc_id", ly.is_scanned(F.col("text"), (F.col("doc_id") % 5).cast("int")).alias("scanned")
    )


@query("x24_w7_table_rows")
def _(spark, d):
    return ly.table_rows(tb.cells(spark, d))


# --- reports and annotation --------------------------------------------------------------------------------------


@query("snk2_report")
def _(spark, d):
    r = rp.reports(corpus.score_corpus(tb.cv_docs(spark, d), tb.TODAY))
    return r.select(
        "doc_id", "filename", "score", "band",
        joined(F.transform("categories", lambda c: F.concat(c["category"], F.lit(":"), c["score"].cast("string"), F.lit(":"), c["note"]))).alias("categories"),
        joined(F.transform("priorities", lambda p: p["rule_id"])).alias("priorities"),
        joined(F.transform("groups", lambda g: F.concat(g["section"], F.lit("="), F.array_join(F.transform(g["findings"], lambda f: f["rule_id"]), ",")))).alias("groups"),
    )


@query("ag10_prompts")
def _(spark, d):
    docs = tb.cv_docs(spark, d)
    out = rp.prompts(corpus.score_corpus(docs, tb.TODAY), docs)
    return out.select("doc_id", F.md5("prompt").alias("prompt"), F.length("prompt").alias("chars"))


def _annotated(spark, d) -> DataFrame:
    docs = tb.cv_docs(spark, d)
    return an.annotate(ru.document_findings(ft.profile(docs, tb.TODAY)))


@query("an1_evidence_spans")
def _(spark, d):
    return an.spans_table(_annotated(spark, d))


@query("an2_line_runs")
def _(spark, d):
    return an.line_runs(_annotated(spark, d))


# --- throttle ----------------------------------------------------------------------------------------------------


@query("st1_throttle")
def _(spark, d):
    return th.throttle(
        tb.table(spark, d, "events"), "user_id", "ts", "event_id", limit=2, window=6 * 3600, bucket="day"
    )


@query("st4_request_counts")
def _(spark, d):
    counts = th.request_counts(tb.table(spark, d, "events"), "user_id", "ts", "6 hours", "1 hour")
    return counts.select("key", F.unix_micros(F.col("window_start").cast("timestamp")).alias("start_micros"), "n")
