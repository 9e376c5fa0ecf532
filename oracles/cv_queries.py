"""Oracle SQL of the queries over career documents."""

from __future__ import annotations

from oracles.cv import cv_sql, joined, lit, round1, verb_hint

SQL: dict[str, str] = {
    "x1_heading_normalise": cv_sql(
        "lines",
        r"""SELECT doc_id, line_no, regexp_replace(lower(regexp_replace(s, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), '[\s&/]+', ' ', 'g') AS norm
        FROM lines WHERE s <> ''""",
    ),
    "x2_heading_match": cv_sql("headings", "SELECT doc_id, line_no, heading, name FROM headings WHERE name IS NOT NULL"),
    "x3_heading_style": cv_sql("headings", "SELECT doc_id, line_no, style FROM headings WHERE style IS NOT NULL"),
    "x4_dominant_style": cv_sql("dominant", "SELECT d.doc_id, m.style FROM docs d LEFT JOIN dominant m ON d.doc_id = m.doc_id"),
    "x5_sections": cv_sql(
        "sections",
        "SELECT doc_id, sec_no, name, heading, start_line, end_line, md5(text) AS body, word_count FROM sections",
    ),
    "x6_largest_section": cv_sql("largest", "SELECT doc_id, name, heading, start_line, word_count FROM largest"),
    "x7_section_presence": cv_sql(
        "recognised",
        """SELECT d.doc_id,
          coalesce(bool_or(s.name = 'experience' AND s.word_count > 0), false) AS has_experience,
          coalesce(bool_or(s.name = 'skills' AND s.word_count > 0), false) AS has_skills,
          coalesce(bool_or(s.name = 'summary' AND s.word_count > 0), false) AS has_summary,
          coalesce(string_agg(DISTINCT s.name, ' ~ ' ORDER BY s.name) FILTER (s.name NOT IN ('header', 'unknown')), '') AS names
        FROM docs d LEFT JOIN sections s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
    ),
    "x8_contact_scope": cv_sql("scope", "SELECT doc_id, md5(header) AS header, scope = header AND contains(header, '@') AS header_only FROM scope"),
    "x9_emails": cv_sql("contacts", f"SELECT doc_id, {joined('emails')} AS emails FROM contacts"),
    "x10_phones": cv_sql("contacts", f"SELECT doc_id, {joined('phones')} AS phones FROM contacts"),
    "x11_links": cv_sql("contacts", f"SELECT doc_id, linkedin, github, {joined('websites')} AS websites FROM contacts"),
    "x12_name": cv_sql("contacts", "SELECT doc_id, name FROM contacts"),
    "x13_location": cv_sql("contacts", "SELECT doc_id, location FROM contacts"),
    "x14_sensitive_terms": cv_sql("contacts", f"SELECT doc_id, {joined('sensitive')} AS sensitive FROM contacts"),
    "x15_x16_bullets": cv_sql("bullets", "SELECT doc_id, line_no, section, body, words, opener FROM bullets"),
    "x17_x18_date_ranges": cv_sql("ranges", "SELECT * FROM ranges"),
    "x19_j4_range_sections": cv_sql("ranges", "SELECT doc_id, range_no, line_no, section, raw, is_current FROM ranges"),
    "x20_work_ranges": cv_sql("work_ranges", "SELECT doc_id, line_no, section, raw FROM work_ranges"),
    "x21_judged_bullets": cv_sql("judged", "SELECT doc_id, line_no, section FROM judged"),
    "tl1_month_ordinals": cv_sql("spans", 'SELECT doc_id, s AS start, seq, e AS "end" FROM spans'),
    "tl2_w4_gaps": cv_sql(
        "gaps",
        """SELECT doc_id, CAST((a - 1) // 12 AS VARCHAR) || '-' || lpad(CAST((a - 1) % 12 + 1 AS VARCHAR), 2, '0') AS gap_from,
          CAST((b - 1) // 12 AS VARCHAR) || '-' || lpad(CAST((b - 1) % 12 + 1 AS VARCHAR), 2, '0') AS gap_to, months FROM gaps""",
    ),
    "tl3_tl4_tl5_tenure": cv_sql(
        "tenures",
        """SELECT doc_id, months, round_even(months / 12, 1) AS years,
          CASE WHEN months >= 144 THEN 3 WHEN months >= 60 THEN 2 ELSE 1 END AS expected_pages FROM tenures""",
    ),
    "fe1_fe2_bullet_flags": cv_sql("judged", "SELECT doc_id, line_no, quantified, weak, strong FROM judged"),
    "fe3_verb_hint": cv_sql("bullets", f"SELECT doc_id, line_no, {verb_hint('body')} AS hint FROM bullets"),
    "fe4_top_opener": cv_sql("impact", "SELECT doc_id, top_opener AS opener, top_n AS n FROM impact"),
    "fe5_fe6_phrase_hits": cv_sql(
        "impact",
        f"""SELECT doc_id, {joined('fillers')} AS fillers, {joined('cliches')} AS cliches, len(pronouns) AS pronouns,
        {joined('list_sort(list_distinct(pronouns))[1:5]')} AS pronoun_sample FROM impact""",
    ),
    "w6_first_n_evidence": cv_sql(
        "impact",
        """SELECT doc_id, coalesce(array_to_string(unq, ' ~ '), '') AS unquantified, coalesce(array_to_string(wb, ' ~ '), '') AS weak,
        tense_n AS tense_sample, past, gerund FROM impact""",
    ),
    **{
        f"rules_{c}": cv_sql(
            "raw_findings",
            f"SELECT doc_id, rule_id, severity, penalty, {joined('evidence')} AS evidence FROM raw_findings WHERE category = {lit(c)}",
        )
        for c in ("contact", "structure", "impact", "ats", "formatting")
    },
    "fe9_section_attribution": cv_sql("findings", "SELECT doc_id, rule_id, section FROM findings"),
    "s1_finding_order": cv_sql("findings", "SELECT doc_id, finding_no, rule_id FROM findings"),
    "ag1_category_scores": cv_sql(
        "cats", "SELECT doc_id, category, score, weight, finding_count, critical_count, penalties, applicable FROM cats"
    ),
    "ag2_ag3_overall": cv_sql("scores", "SELECT doc_id, overall, band FROM scores"),
    "ag4_s2_priorities": cv_sql("prios", "SELECT doc_id, rank, rule_id, penalty, overall_gain FROM prios"),
    "ag4_f9_projection": cv_sql(
        "projections",
        f"SELECT doc_id, {round1('overall')} AS overall, projected_score, projected_score > overall + 0.5 AS show_projection FROM projections",
    ),
    "snk1_stored_reviews": cv_sql(
        "prios",
        """SELECT s.doc_id, 'complete' AS status, CAST(NULL AS VARCHAR) AS error, s.overall, s.band,
          (SELECT count(*) FROM findings f WHERE f.doc_id = s.doc_id) AS n_findings,
          (SELECT count(*) FROM cats c WHERE c.doc_id = s.doc_id) AS n_categories,
          (SELECT count(*) FROM prios p WHERE p.doc_id = s.doc_id) AS n_priorities
        FROM scores s""",
    ),
    "ag5_snapshot": cv_sql(
        "times",
        """SELECT d.doc_id,
          coalesce((SELECT string_agg(DISTINCT name, ' ~ ' ORDER BY name) FROM recognised r WHERE r.doc_id = d.doc_id), '') AS detected_sections,
          (SELECT string_agg(name || ':' || CAST(word_count AS VARCHAR), ' ~ ' ORDER BY sec_no) FROM sections s
            WHERE s.doc_id = d.doc_id AND (s.name <> 'unknown' OR s.word_count > 0)) AS sections,
          (SELECT count(*) FROM bullets b WHERE b.doc_id = d.doc_id) AS bullet_count,
          t.n_ranges AS range_count, t.n_gaps AS gap_count, t.months AS experience_months,
          round_even(t.months / 12, 1) AS experience_years, l.word_count, l.page_count
        FROM docs d JOIN times t ON d.doc_id = t.doc_id JOIN layouts l ON d.doc_id = l.doc_id""",
    ),
}
