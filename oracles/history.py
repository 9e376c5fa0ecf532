"""Oracle SQL of the queries over stored reviews."""

from __future__ import annotations

from oracles.cv import cv_sql, rank_case, round1, values
from vitalens import lexicon as lx
from vitalens.sources import tables as tb

_VIEWS = [
    ("reviews", tb.DUCKDB.render(tb.EV_REVIEWS)),
    ("docs", tb.DUCKDB.render(tb.EV_DOCS)),
    ("findings", tb.DUCKDB.render(tb.EV_FINDINGS)),
    ("days", tb.DUCKDB.render(tb.EV_DAYS)),
    ("owners", tb.DUCKDB.render(tb.OWNERS)),
    ("done", "SELECT * FROM reviews WHERE status = 'complete'"),
    ("recent", "SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, review_id DESC) AS rn FROM done"),
    ("days_done", "SELECT * FROM days WHERE status = 'complete'"),
    (
        "pairs",
        """SELECT review_id, baseline_id FROM (SELECT c.review_id, coalesce(
             (SELECT max_by(b.review_id, (b.created_at, b.review_id)) FROM days_done b WHERE b.doc_id = c.doc_id AND b.owner_id = c.owner_id AND b.created_at < c.created_at),
             (SELECT max_by(b.review_id, (b.created_at, b.review_id)) FROM days_done b WHERE b.owner_id = c.owner_id AND b.created_at < c.created_at)) AS baseline_id
           FROM days_done c) WHERE baseline_id IS NOT NULL""",
    ),
    ("days_left", "SELECT * FROM days WHERE NOT ends_with(owner_id, '3') AND NOT ends_with(doc_id, '8') AND NOT ends_with(review_id, '-05')"),
    (
        "cat_scores",
        f"""SELECT d.review_id, c.category, greatest(0.0, least(100.0, 100.0 - coalesce(sum(f.penalty), 0.0))) AS score
          FROM days d CROSS JOIN {values([(c,) for c, _ in lx.CATEGORY_WEIGHTS if c != 'keywords'], 'category')} c
          LEFT JOIN findings f ON f.review_id = d.review_id AND f.category = c.category GROUP BY d.review_id, c.category""",
    ),
    (
        "cat_deltas",
        f"""SELECT p.review_id, p.baseline_id, a.category, {round1('CAST(a.score AS DOUBLE)')} AS current, {round1('CAST(b.score AS DOUBLE)')} AS baseline,
          {round1('CAST(a.score - b.score AS DOUBLE)')} AS delta
        FROM pairs p JOIN cat_scores a ON a.review_id = p.review_id JOIN cat_scores b ON b.review_id = p.baseline_id AND a.category = b.category""",
    ),
    ("open_rules", "SELECT DISTINCT review_id, rule_id, severity FROM findings WHERE severity <> 'positive'"),
    (
        "diff",
        """SELECT review_id, baseline_id, rule_id, coalesce(any_value(severity) FILTER (cur), any_value(severity)) AS severity,
           CASE WHEN bool_or(cur) AND bool_or(NOT cur) THEN 'still_open' WHEN bool_or(cur) THEN 'introduced' ELSE 'resolved' END AS change
         FROM (SELECT p.review_id, p.baseline_id, r.rule_id, r.severity, true AS cur FROM pairs p JOIN open_rules r ON r.review_id = p.review_id
               UNION ALL SELECT p.review_id, p.baseline_id, r.rule_id, r.severity, false FROM pairs p JOIN open_rules r ON r.review_id = p.baseline_id)
         GROUP BY review_id, baseline_id, rule_id""",
    ),
    (
        "numbered",
        f"SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY {rank_case()}, -penalty, category, rule_id) AS finding_no FROM findings",
    ),
]


def sql(select: str) -> str:
    used, need = [], select
    for name, body in reversed(_VIEWS):
        if f" {name} " in f" {need} ".replace("\n", " ").replace(")", " ").replace("(", " ").replace(",", " "):
            used.append((name, body))
            need += " " + body
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({b})" for n, b in reversed(used)) + " " + select


SQL: dict[str, str] = {
    "ag6_owner_stats": sql(
        f"""SELECT coalesce(d.owner_id, r.owner_id) AS owner_id, coalesce(d.n, 0) AS doc_count, coalesce(r.n, 0) AS review_count,
          {round1('best')} AS best, {round1('latest')} AS latest, {round1('latest - previous')} AS delta
        FROM (SELECT owner_id, count(*) AS n FROM docs GROUP BY owner_id) d
        FULL JOIN (SELECT owner_id, count(*) AS n, max(overall) AS best, max(overall) FILTER (rn = 1) AS latest, max(overall) FILTER (rn = 2) AS previous
              FROM recent GROUP BY owner_id) r ON d.owner_id = r.owner_id"""
    ),
    "ag7_review_counts": sql("SELECT doc_id, count(*) AS review_count, max(created_at) AS last_review_at FROM reviews GROUP BY doc_id"),
    "j2_decorated_documents": sql(
        """SELECT d.doc_id, d.filename, (SELECT count(*) FROM reviews r WHERE r.doc_id = d.doc_id) AS review_count,
          (SELECT max_by(overall, (created_at, review_id)) FROM done r WHERE r.doc_id = d.doc_id) AS latest_score FROM docs d"""
    ),
    "w1_latest_score": sql(
        """SELECT doc_id, overall AS latest_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, review_id DESC) AS rn FROM done ) WHERE rn = 1"""
    ),
    "w2_document_deltas": sql(
        f"""SELECT review_id, doc_id, CASE WHEN status = 'complete' AND ps = 'complete' THEN {round1('overall - po')} END AS delta
        FROM (SELECT *, lag(status) OVER w AS ps, lag(overall) OVER w AS po FROM reviews
              WINDOW w AS (PARTITION BY doc_id ORDER BY created_at, review_id))"""
    ),
    "w3_owner_deltas": sql(
        f"""SELECT owner_id, latest, previous, {round1('latest - previous')} AS delta FROM (
          SELECT owner_id, max(overall) FILTER (rn = 1) AS latest, max(overall) FILTER (rn = 2) AS previous FROM recent GROUP BY owner_id)"""
    ),
    "w8_trend": sql(
        """SELECT owner_id, review_id, overall AS score, 50 - rn AS position FROM (
          SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, review_id DESC) AS rn FROM reviews )
        WHERE rn <= 50 AND status = 'complete'"""
    ),
    "j1_f5_summaries": sql(
        """SELECT r.review_id, r.doc_id, r.status, r.overall, r.ai_review IS NOT NULL AS has_ai_review, d.filename
        FROM reviews r LEFT JOIN docs d ON r.doc_id = d.doc_id"""
    ),
    "s3_history_page": sql(
        """SELECT r.review_id, r.doc_id, d.filename, r.overall FROM (
          SELECT * FROM reviews WHERE owner_id = '7' ORDER BY created_at DESC, review_id DESC LIMIT 25 OFFSET 10) r
        LEFT JOIN docs d ON r.doc_id = d.doc_id"""
    ),
    "f1_f3_owner_document": sql("SELECT review_id, status, overall FROM reviews WHERE owner_id = '8' AND doc_id = '8-1'"),
    "f2_f4_complete_in_list": sql(
        "SELECT doc_id, count(*) AS n FROM done WHERE doc_id IN (SELECT doc_id FROM docs WHERE filename LIKE 'upload-1%') GROUP BY doc_id"
    ),
    "src7_key_scan": sql("SELECT review_id, owner_id, overall FROM reviews WHERE review_id = 1234"),
    "f10_score_colour": sql(
        "SELECT review_id, CASE WHEN overall >= 85 THEN 'green' WHEN overall >= 55 THEN 'amber' ELSE 'red' END AS colour FROM reviews "
    ),
    "s4_sorted_history": sql("SELECT review_id, overall FROM done WHERE owner_id = '3' ORDER BY overall DESC"),
    "s7_documents_newest_first": sql("SELECT doc_id, filename FROM docs WHERE owner_id = '5'"),
    "src5_quota": sql(
        """SELECT owner_id, review_id AS doc_id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at, review_id) <= 50 AS accepted FROM reviews """
    ),
    "src6_stored_layout": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 0 AS table_count, false AS is_scanned FROM events",
    "j5_baselines": sql(
        """SELECT c.review_id, coalesce(
          (SELECT max_by(b.review_id, (b.created_at, b.review_id)) FROM done b WHERE b.doc_id = c.doc_id AND b.owner_id = c.owner_id AND b.created_at < c.created_at),
          (SELECT max_by(b.review_id, (b.created_at, b.review_id)) FROM done b WHERE b.owner_id = c.owner_id AND b.created_at < c.created_at)) AS baseline_id
        FROM done c"""
    ),
    "j6_explicit_baselines": sql(
        """SELECT p.review_id, p.baseline_id, CASE WHEN c.status <> 'complete' THEN 'review_incomplete'
          WHEN p.review_id = p.baseline_id THEN 'same_review'
          WHEN b.review_id IS NULL OR b.owner_id <> c.owner_id OR b.status <> 'complete' THEN 'baseline_not_found' END AS reason
        FROM (SELECT review_id, CASE review_id % 5 WHEN 0 THEN review_id WHEN 1 THEN -review_id ELSE (review_id * 3) % (SELECT count(*) FROM reviews) END AS baseline_id FROM reviews ) p
        JOIN reviews c ON c.review_id = p.review_id LEFT JOIN reviews b ON b.review_id = p.baseline_id"""
    ),
    "j7_finding_diff": sql("SELECT review_id, baseline_id, rule_id, severity, change FROM diff "),
    "j8_category_deltas": sql("SELECT review_id, baseline_id, category, current, baseline, delta FROM cat_deltas "),
    "compare_reviews": sql(
        f"""SELECT p.review_id, p.baseline_id, {round1('a.overall - b.overall')} AS overall_delta,
          (SELECT count(*) FROM cat_deltas c WHERE c.review_id = p.review_id AND c.baseline_id = p.baseline_id) AS n_categories,
          coalesce((SELECT string_agg(rule_id || ':' || severity, ' ~ ' ORDER BY rule_id) FROM diff d WHERE d.review_id = p.review_id AND d.baseline_id = p.baseline_id AND change = 'resolved'), '') AS resolved,
          coalesce((SELECT string_agg(rule_id || ':' || severity, ' ~ ' ORDER BY rule_id) FROM diff d WHERE d.review_id = p.review_id AND d.baseline_id = p.baseline_id AND change = 'introduced'), '') AS introduced,
          (SELECT count(*) FROM diff d WHERE d.review_id = p.review_id AND d.baseline_id = p.baseline_id AND change = 'still_open') AS still_open
        FROM pairs p JOIN days a ON a.review_id = p.review_id JOIN days b ON b.review_id = p.baseline_id"""
    ),
    "j9_erasure": sql(
        """SELECT 'reviews' AS name, review_id AS id, count(*) AS n FROM days_left GROUP BY review_id
        UNION ALL SELECT 'docs', doc_id, count(*) FROM docs WHERE NOT ends_with(owner_id, '3') AND doc_id NOT IN (SELECT doc_id FROM days WHERE ends_with(doc_id, '8')) GROUP BY doc_id
        UNION ALL SELECT 'findings', review_id, count(*) FROM findings WHERE review_id IN (SELECT review_id FROM days_left ) GROUP BY review_id
        UNION ALL SELECT 'category_scores', review_id, count(*) FROM cat_scores WHERE review_id IN (SELECT review_id FROM days_left ) GROUP BY review_id"""
    ),
    "ag_cube": sql(
        f"""SELECT ai, colour, month, CAST(grouping_id(ai, colour, month) AS INT) AS grouping_id, count(*) AS n, max(overall) AS best,
          {round1('CAST(sum(CAST(overall AS DECIMAL(20,6))) AS DOUBLE) / count(*)')} AS mean, true AS documents_near
        FROM (SELECT *, ai_review IS NOT NULL AS ai, strftime(created_at, '%Y-%m') AS month,
                CASE WHEN overall >= 85 THEN 'green' WHEN overall >= 55 THEN 'amber' ELSE 'red' END AS colour FROM done ) x
        GROUP BY CUBE (ai, colour, month)"""
    ),
    "st3_distinct_uploads": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS owner_id, sha256(props) AS text_hash FROM events",
    # At most one per 30 days, counted from the one that was kept.
    "st3_batch_uploads": """WITH RECURSIVE e AS MATERIALIZED (
          SELECT user_id, props, event_id, ts, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS rn FROM events),
        walk AS (
          SELECT user_id, props, event_id, rn, ts AS held, true AS kept FROM e WHERE rn = 1
          UNION ALL
          SELECT e.user_id, e.props, e.event_id, e.rn, CASE WHEN e.ts > w.held + INTERVAL 30 DAY THEN e.ts ELSE w.held END, e.ts > w.held + INTERVAL 30 DAY
          FROM walk w JOIN e ON e.user_id = w.user_id AND e.props = w.props AND e.rn = w.rn + 1)
        SELECT CAST(user_id AS VARCHAR) AS owner_id, event_id FROM walk WHERE kept""",
    "p10_role_fallback": sql(
        "SELECT r.review_id, coalesce(nullif(r.target_role, ''), o.target_role) AS target_role FROM reviews r LEFT JOIN owners o ON r.owner_id = o.owner_id"
    ),
    "f6_severity_counts": sql("SELECT review_id, severity, count(*) AS n FROM findings GROUP BY review_id, severity"),
    "ag8_grouped_findings": sql(
        f"""SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY kind, pos, first) AS group_no, section, rules FROM (
          SELECT review_id, section, CASE WHEN section = 'document' THEN 0 WHEN section IN ('header', 'summary', 'experience', 'education') THEN 1 ELSE 2 END AS kind,
            CASE section WHEN 'header' THEN 0 WHEN 'summary' THEN 1 WHEN 'experience' THEN 2 WHEN 'education' THEN 3 ELSE 0 END AS pos,
            min(finding_no) AS first, string_agg(rule_id, ',' ORDER BY finding_no) AS rules
          FROM (SELECT review_id, coalesce(section, 'document') AS section, rule_id, finding_no FROM numbered ) GROUP BY review_id, section)"""
    ),
    "ag9_findings_digest": sql(
        """SELECT review_id, string_agg('- [' || severity || '] ' || rule_id, chr(10) ORDER BY finding_no) AS digest FROM (
          SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY finding_no) AS rn FROM numbered WHERE severity <> 'positive')
        WHERE rn <= 12 GROUP BY review_id"""
    ),
    "f7_f8_layout_cause": cv_sql(
        "raw_findings",
        """SELECT doc_id AS review_id, bool_or(rule_id = 'ats.multi_column') AND bool_or(starts_with(rule_id, 'structure.empty_')) AS root_cause
        FROM raw_findings GROUP BY doc_id""",
    ),
    "f7_applicable_categories": cv_sql(
        "cats", "SELECT category, applicable, count(*) AS n, sum(finding_count) AS findings FROM cats GROUP BY category, applicable"
    ),
}
