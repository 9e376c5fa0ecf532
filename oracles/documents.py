"""Oracle SQL of text, layout, report and throttle queries."""

from __future__ import annotations

from oracles.cv import cv_sql, strip, words
from vitalens.sources import tables as tb

_DIRTY = tb.DUCKDB.render(tb.DIRTY_DOCS)
_BULLETS = "•●▪◦‣⁃·∙▫■❋❖➜➢→"
_B = f"[{_BULLETS}]"


def _glyphs(t: str) -> str:
    for a, b in [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("‘", "''"), ("’", "''"),
                 ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("−", "-"), ("​", "")]:
        t = f"replace({t}, '{a}', '{b}')"
    return t


def _control(t: str) -> str:
    return rf"regexp_replace({t}, '[^\P{{C}}\n\t]', '', 'g')"


def _bullets(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '(?m)^\s*{_B}\s*', '• ', 'g'), '{_B}', '•', 'g')"


def _tidy(t: str) -> str:
    lines = rf"regexp_replace(replace({t}, chr(9), '    '), '(?m)[^\S\n]+$', '', 'g')"
    return strip(rf"regexp_replace({lines}, '\n\n\n+', chr(10) || chr(10), 'g')")


def _body(t: str) -> str:
    return f"SELECT doc_id, md5({t}) AS body FROM ({_DIRTY})"


_CLEAN = _tidy(_control("text"))

# Documents of plain text, cleaned, as the chain of the career documents takes them.
_PLAIN_DOCS = f"""SELECT *, CAST(NULL AS INT) AS page_count, 0 AS table_count, 0 AS image_count, 0 AS multi_column_pages,
    false AS has_header_footer_text, false AS is_scanned FROM (SELECT doc_id, {_CLEAN} AS text FROM documents) WHERE length(text) >= 100"""

SQL: dict[str, str] = {
    "p1_nfkc": "SELECT doc_id, md5(nfc_normalize(text)) AS body FROM documents",
    "p2_glyph_map": _body(_glyphs("text")),
    "p3_drop_control": _body(_control("text")),
    "p4_bullets": _body(_tidy(_bullets(_control("text")))),
    "p2_p5_clean": _body(_tidy(_bullets(_control(_glyphs("text"))))),
    "p6_p7_words_pages": f"""SELECT doc_id, w AS words, greatest(1, CAST(round_even(w / 500.0, 0) AS INT)) AS pages
      FROM (SELECT doc_id, {words('text')} AS w FROM documents)""",
    "p8_flat_text": _body(r"regexp_replace(lower(text), '\s+', ' ', 'g')"),
    "p9_tidy_input": f"""SELECT doc_id, line_no, nullif({strip('line')}, '') AS tidy FROM (
      SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM ({_DIRTY})))""",
    "p11_truncate": """SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || '(cut here: the rest is longer than the limit)' ELSE text END) AS body FROM documents""",
    "p12_lines": """SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, length(unnest(ls)) AS chars
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""",
    "src3_near_empty": f"SELECT doc_id FROM documents WHERE length({strip('text')}) < 100",
    "src1_src4_screen": f"""SELECT path, ext AS extension,
        CASE WHEN length > 5242880 THEN 'too_large' WHEN length = 0 THEN 'empty_file' WHEN ext = '.doc' THEN 'legacy_format'
             WHEN ext NOT IN ('.pdf', '.docx', '.txt', '.md') THEN 'unsupported_type'
             WHEN ext NOT IN ('.txt', '.md') THEN 'needs_text_extraction' END AS reject_reason
      FROM (SELECT path, length, CASE WHEN contains(path, '.') THEN lower('.' || split_part(path, '.', 2)) ELSE '' END AS ext
            FROM ({tb.DUCKDB.render(tb.FILES)}))""",
    "src8_fingerprint": "SELECT doc_id, sha256(text) AS text_hash FROM documents",
    "src8_repeated_uploads": "SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "fe7_exotic_characters": rf"""SELECT doc_id, len(x) AS n, array_to_string(list_filter(x, lambda c, i: list_position(x, c) = i)[1:10], '') AS sample
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x7F\x{{C0}}-\x{{24F}}•–—’“”\s]') AS x FROM ({_DIRTY}))""",
    "fe8_line_stats": r"""SELECT doc_id, len(ls) AS lines, len(list_filter(ls, lambda l: regexp_matches(l, '\S'))) AS filled,
        len(list_filter(ls, lambda l: regexp_matches(l, '\S') AND length(l) > 130)) AS overlong
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""",
    "documents_length_rules": cv_sql(
        "raw_findings", "SELECT doc_id, rule_id, severity, CAST(penalty AS DOUBLE) AS penalty FROM raw_findings", docs=_PLAIN_DOCS
    ),
    "x23_scanned": "SELECT doc_id, doc_id % 5 > 0 AND length(text) < 200 * (doc_id % 5) AS scanned FROM documents",
    "x24_w7_table_rows": f"""SELECT doc_id, table_no, row_no, string_agg(cell, ' | ' ORDER BY col_no) AS line FROM (
        SELECT *, lag(cell) OVER (PARTITION BY doc_id, table_no, row_no ORDER BY col_no) AS before
        FROM ({tb.DUCKDB.render(tb.CELLS)}) WHERE cell <> '')
      WHERE before IS NULL OR before <> cell GROUP BY doc_id, table_no, row_no""",
    "st1_throttle": """WITH RECURSIVE ev AS (
        SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, epoch_us(ts) AS micros,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      st AS (
        SELECT key, rn, id, micros, [micros] AS log, true AS admitted, CAST(NULL AS INT) AS retry_after FROM ev WHERE rn = 1
        UNION ALL
        SELECT key, rn, id, micros, CASE WHEN len(l) < 2 THEN list_append(l, micros) ELSE l END, len(l) < 2,
               CASE WHEN len(l) >= 2 THEN greatest(1, CAST(trunc(21600 - (micros - l[1]) / 1000000.0) AS INT) + 1) END
        FROM (SELECT e.*, list_filter(s.log, lambda x: e.micros - x <= 21600000000) AS l FROM st s JOIN ev e ON e.key = s.key AND e.rn = s.rn + 1))
      SELECT key, id, micros, admitted, retry_after, CASE WHEN NOT admitted THEN 'limit' END AS reason FROM st""",
    "st4_request_counts": """SELECT CAST(user_id AS VARCHAR) AS key, start_micros, count(*) AS n FROM (
        SELECT user_id, (epoch_us(ts) // 3600000000 - unnest(range(6))) * 3600000000 AS start_micros FROM events)
      GROUP BY ALL""",
}

_COLUMNS = f"""SELECT doc_id, page, n AS n_words, n >= 40 AND least(l, r) / n > 0.22 AND (n - l - r) / n < 0.12 AS two_column
  FROM (SELECT doc_id, page, count(*) AS n, count(*) FILTER (x1 < 306 - 612 * 0.06) AS l,
          count(*) FILTER (NOT x1 < 306 - 612 * 0.06 AND x0 > 306 + 612 * 0.06) AS r
        FROM ({tb.DUCKDB.render(tb.WORD_BOXES)}) GROUP BY doc_id, page)"""
SQL["x22_two_column_pages"] = _COLUMNS
SQL["x22_multi_column_counts"] = (
    f"SELECT doc_id, count(*) FILTER (two_column) AS multi_column_pages FROM ({_COLUMNS}) GROUP BY doc_id"
)

_GROUPS = """SELECT doc_id, string_agg(section || '=' || rules, ' ~ ' ORDER BY kind, at_no, first) AS groups FROM (
    SELECT f.doc_id, f.section, string_agg(rule_id, ',' ORDER BY finding_no) AS rules, min(finding_no) AS first,
      CASE WHEN f.section = 'document' THEN 0 WHEN o.at_no IS NOT NULL THEN 1 ELSE 2 END AS kind, coalesce(o.at_no, 0) AS at_no
    FROM (SELECT doc_id, coalesce(section, 'document') AS section, rule_id, finding_no FROM findings) f
    LEFT JOIN (SELECT doc_id, name, min(sec_no) AS at_no FROM sections WHERE name <> 'unknown' GROUP BY doc_id, name) o
      ON o.doc_id = f.doc_id AND o.name = f.section
    GROUP BY f.doc_id, f.section, o.at_no) GROUP BY doc_id"""
SQL["snk2_report"] = cv_sql(
    "projections",
    f"""SELECT d.doc_id, d.filename, CAST(floor(s.overall + 0.5) AS INT) AS score, s.band,
      (SELECT string_agg(category || ':' || CAST(CAST(floor(score + 0.5) AS INT) AS VARCHAR) || ':' ||
         CASE WHEN critical_count > 0 THEN CAST(critical_count AS VARCHAR) || ' critical'
              WHEN finding_count > 0 THEN CAST(finding_count AS VARCHAR) || ' finding(s)' ELSE 'clear' END, ' ~ '
         ORDER BY list_position(['contact', 'structure', 'impact', 'ats', 'formatting'], category))
       FROM cats c WHERE c.doc_id = d.doc_id AND applicable) AS categories,
      coalesce((SELECT string_agg(rule_id, ' ~ ' ORDER BY rank) FROM prios p WHERE p.doc_id = d.doc_id), '') AS priorities,
      g.groups
    FROM docs d JOIN scores s ON d.doc_id = s.doc_id JOIN ({_GROUPS}) g ON g.doc_id = d.doc_id""",
)
_PROMPT = """'Role: unspecified' || chr(10)
  || 'Score: ' || CAST(CAST(round_even(s.overall, 0) AS INT) AS VARCHAR) || '/100 (' || s.band || ')' || chr(10)
  || 'Sections: ' || coalesce((SELECT string_agg(DISTINCT name, ', ' ORDER BY name) FROM recognised r WHERE r.doc_id = d.doc_id), 'none') || chr(10)
  || 'Length: ' || CAST(l.word_count AS VARCHAR) || ' words, ' || CAST(l.page_count AS VARCHAR) || ' page(s)' || chr(10)
  || 'Months of experience: ' || CAST(t.months AS VARCHAR) || chr(10)
  || 'Bullets: ' || CAST((SELECT count(*) FROM bullets b WHERE b.doc_id = d.doc_id) AS VARCHAR) || chr(10)
  || 'Findings:' || chr(10)
  || coalesce((SELECT string_agg('- [' || severity || '] ' || rule_id, chr(10) ORDER BY finding_no) FROM (
       SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY finding_no) AS rn FROM findings WHERE severity <> 'positive') f
       WHERE f.doc_id = d.doc_id AND rn <= 12), '- (none)') || chr(10)
  || 'No posting was supplied.' || chr(10)
  || '<<document>>' || chr(10)
  || CASE WHEN length(d.text) > 24000 THEN left(d.text, 24000) || chr(10) || '(cut here: the rest is longer than the limit)' ELSE d.text END
  || chr(10) || '<</document>>'"""
SQL["ag10_prompts"] = cv_sql(
    "scores",
    f"""SELECT doc_id, md5(p) AS prompt, length(p) AS chars FROM (SELECT d.doc_id, {_PROMPT} AS p
    FROM docs d JOIN scores s ON s.doc_id = d.doc_id JOIN layouts l ON l.doc_id = d.doc_id JOIN tenures t ON t.doc_id = d.doc_id)""",
)
