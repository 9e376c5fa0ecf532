"""Oracle SQL of keyword matching."""

from __future__ import annotations

from oracles.cv import cv_sql, in_list, joined, lit, band_case, round1, str_list, values, weight_case, rank_case
from vitalens import lexicon as lx
from vitalens.sources import tables as tb

_BREAK = r"[,;:|/()\[\]{}]|\.\s|\band\b|\bor\b|\bwith\b|\bin\b"
# Letters beyond ASCII take part in word boundaries but not in tokens.
_ASCII = r"regexp_replace({0}, '[\x{{C0}}-\x{{24F}}]', '_', 'g')"


def stem(t: str) -> str:
    def undouble(x: str) -> str:
        return (
            f"CASE WHEN length({x}) > 2 AND {x}[-1] = {x}[-2] AND {x}[-1] NOT IN ('l', 's', 'z') "
            f"THEN left({x}, length({x}) - 1) ELSE {x} END"
        )

    ing, ed = f"left({t}, length({t}) - 3)", f"left({t}, length({t}) - 2)"
    base = (
        f"CASE WHEN ends_with({t}, 'ies') AND length({t}) > 4 THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN ends_with({t}, 'ing') AND length({t}) > 5 THEN {undouble(ing)} "
        f"WHEN ends_with({t}, 'ed') AND length({t}) > 4 THEN {undouble(ed)} "
        f"WHEN ends_with({t}, 'es') AND length({t}) > 4 AND {t}[-3] IN ('s','x','z','h','i','o') THEN left({t}, length({t}) - 2) "
        f"WHEN ends_with({t}, 's') AND NOT ends_with({t}, 'ss') AND length({t}) > 3 THEN left({t}, length({t}) - 1) "
        f"ELSE {t} END"
    )
    return (
        f"CASE WHEN {t} IN {in_list(lx.PROTECTED_TOKENS)} OR length({t}) <= 3 OR NOT regexp_full_match({t}, '[a-z]+') THEN {t} "
        f"ELSE (SELECT CASE WHEN length(b) > 3 AND ends_with(b, 'e') THEN left(b, length(b) - 1) ELSE b END "
        f"FROM (SELECT {base} AS b)) END"
    )


def noise(t: str) -> str:
    return f"(length({t}) < 2 OR {t} IN {in_list(lx.noise_words())})"


def weight(line: str) -> str:
    marks = " OR ".join(f"contains(lower({line}), {lit(m)})" for m in lx.REQUIREMENT_MARKERS)
    return f"CASE WHEN {marks} THEN 2.5 WHEN regexp_matches({line}, '^\\s*[•\\-*]') THEN 1.6 ELSE 1.0 END"


def token_steps(source: str, key: str, p: str) -> list[tuple[str, str]]:
    """Lines, chunks, tokens, stems and pairs of ``source`` (key, text), named with prefix ``p``."""
    return [
        (
            f"{p}lines",
            f"""SELECT {key}, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no
              FROM (SELECT {key}, string_split(text, chr(10)) AS ls FROM {source})""",
        ),
        (
            f"{p}pieces",
            f"""SELECT {key}, line_no, unnest(ps) AS piece, generate_subscripts(ps, 1) AS piece_no
              FROM (SELECT {key}, line_no, string_split_regex({_ASCII.format('lower(line)')}, {lit(_BREAK)}) AS ps FROM {p}lines)""",
        ),
        (
            f"{p}raw_tokens",
            f"""SELECT {key}, line_no, piece_no, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos_no
              FROM (SELECT {key}, line_no, piece_no,
                list_filter(list_transform(regexp_extract_all(piece, '[a-z][a-z0-9+#./-]*'), lambda t: regexp_replace(t, '[./-]+$', '')), lambda t: t <> '') AS ts
                FROM {p}pieces)""",
        ),
        (f"{p}stems", f"SELECT token, {stem('token')} AS stem FROM (SELECT DISTINCT token FROM {p}raw_tokens)"),
        (
            f"{p}tokens",
            f"""SELECT r.*, s.stem, lead(r.token) OVER w AS next_token, lead(s.stem) OVER w AS next_stem
              FROM {p}raw_tokens r JOIN {p}stems s ON r.token = s.token
              WINDOW w AS (PARTITION BY {key}, line_no, piece_no ORDER BY pos_no)""",
        ),
    ]


def term_steps(source: str, p: str, limit: int = lx.MAX_POSTING_TERMS) -> list[tuple[str, str]]:
    return token_steps(source, "posting_id", p) + [
        (f"{p}weights", f"SELECT posting_id, line_no, CAST({weight('line')} AS DECIMAL(18,4)) AS w FROM {p}lines"),
        (
            f"{p}records",
            f"""SELECT t.posting_id, token AS surface, stem AS key, w, t.line_no, piece_no, pos_no
              FROM {p}tokens t JOIN {p}weights x ON t.posting_id = x.posting_id AND t.line_no = x.line_no WHERE NOT {noise('token')}
              UNION ALL
              SELECT t.posting_id, token || ' ' || next_token, stem || ' ' || next_stem, CAST(w * 1.4 AS DECIMAL(18,4)), t.line_no, piece_no, pos_no
              FROM {p}tokens t JOIN {p}weights x ON t.posting_id = x.posting_id AND t.line_no = x.line_no
              WHERE next_token IS NOT NULL AND length(token) >= 3 AND length(next_token) >= 3
                AND NOT {noise('token')} AND NOT {noise('next_token')}""",
        ),
        (
            f"{p}surfaces",
            f"""SELECT posting_id, key, surface, row_number() OVER (PARTITION BY posting_id, key ORDER BY count(*) DESC, min((line_no, piece_no, pos_no))) AS rn
              FROM {p}records GROUP BY posting_id, key, surface""",
        ),
        (
            f"{p}cands",
            f"""SELECT r.posting_id, r.key, s.surface AS term, r.weight, len(string_split(r.key, ' ')) AS words
              FROM (SELECT posting_id, key, sum(w) AS weight FROM {p}records GROUP BY posting_id, key) r
              JOIN {p}surfaces s ON r.posting_id = s.posting_id AND r.key = s.key AND s.rn = 1""",
        ),
        (
            f"{p}ranked",
            f"SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY weight DESC, words DESC, key) AS rk FROM {p}cands",
        ),
        (
            f"{p}terms",
            f"""SELECT posting_id, rank, key, term, weight FROM (
                SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY rk) AS rank FROM {p}ranked u
                WHERE words > 1 OR NOT EXISTS (SELECT 1 FROM {p}ranked b WHERE b.posting_id = u.posting_id AND b.words > 1
                  AND b.rk < u.rk AND list_contains(string_split(b.key, ' '), u.key)))
              WHERE rank <= {limit}""",
        ),
    ]


def forms_step(p: str) -> tuple[str, str]:
    return (
        f"{p}forms",
        f"""SELECT DISTINCT doc_id, form FROM (
            SELECT doc_id, unnest([token, stem]) AS form FROM {p}tokens
            UNION ALL SELECT doc_id, unnest([token || ' ' || next_token, stem || ' ' || next_stem]) FROM {p}tokens WHERE next_token IS NOT NULL)""",
    )


def _words_of_lexicon() -> list[str]:
    out = []
    for c, aliases in lx.SKILL_ALIASES.items():
        for f in (c, *aliases):
            out += f.split(" ")
    return sorted(set(out))


_PAIRS = [(a, c) for c, aliases in lx.SKILL_ALIASES.items() for a in aliases]
ALIAS_STEPS = [
    ("lex_words", f"SELECT w, {stem('w')} AS s FROM (SELECT unnest({str_list(_words_of_lexicon())}) AS w)"),
    (
        "lex_names",
        f"""SELECT name, string_agg(s, ' ' ORDER BY i) AS key FROM (
            SELECT name, unnest(string_split(name, ' ')) AS w, generate_subscripts(string_split(name, ' '), 1) AS i
            FROM (SELECT unnest({str_list(sorted({x for p in _PAIRS for x in p}))}) AS name)) x JOIN lex_words USING (w) GROUP BY name""",
    ),
    ("aliases", f"SELECT a.alias, a.canonical FROM {values(_PAIRS, 'alias, canonical')} a"),
]


def spelled_steps(t: str) -> list[tuple[str, str]]:
    """The forms of ``t``terms, aliases among them."""
    return ALIAS_STEPS + [
        ("canon", f"SELECT x.posting_id, x.rank, x.key, x.term, x.weight, coalesce(a.canonical, x.term) AS canonical FROM {t}terms x LEFT JOIN aliases a ON a.alias = x.term"),
        (
            "term_forms",
            """SELECT DISTINCT posting_id, rank, form FROM (
               SELECT posting_id, rank, unnest([key, term]) AS form FROM canon
               UNION ALL SELECT posting_id, rank, canonical FROM canon
               UNION ALL SELECT posting_id, rank, n.key FROM canon c JOIN lex_names n ON n.name = c.canonical
               UNION ALL SELECT posting_id, rank, a.alias FROM canon c JOIN aliases a ON a.canonical = c.canonical
               UNION ALL SELECT posting_id, rank, n.key FROM canon c JOIN aliases a ON a.canonical = c.canonical JOIN lex_names n ON n.name = a.alias)""",
        ),
    ]


def match_steps(t: str, f: str, requests: str) -> list[tuple[str, str]]:
    """Terms ``t``terms against forms ``f``forms for pairs in ``requests``."""
    return spelled_steps(t) + [
        ("requests", requests),
        (
            "found",
            f"""SELECT r.doc_id, r.posting_id, t.rank, list(t.form ORDER BY t.form) AS variants
              FROM requests r JOIN term_forms t ON r.posting_id = t.posting_id
              JOIN {f}forms v ON v.doc_id = r.doc_id AND v.form = t.form GROUP BY r.doc_id, r.posting_id, t.rank""",
        ),
        (
            "matches",
            f"""SELECT r.doc_id, r.posting_id, x.rank, x.term, x.weight, f.rank IS NOT NULL AS in_doc, coalesce(f.variants, []) AS variants
              FROM requests r JOIN {t}terms x ON r.posting_id = x.posting_id
              LEFT JOIN found f ON f.doc_id = r.doc_id AND f.posting_id = r.posting_id AND f.rank = x.rank""",
        ),
        (
            "coverages",
            """SELECT doc_id, posting_id,
                 round(CAST(coalesce(sum(weight) FILTER (in_doc), 0) AS DOUBLE) / CAST(sum(weight) AS DOUBLE), 4) AS coverage,
                 count(*) FILTER (in_doc) AS matched_count, count(*) AS total_count,
                 coalesce(list(term ORDER BY rank) FILTER (NOT in_doc), []) AS missing,
                 coalesce(list(term ORDER BY rank) FILTER (in_doc), []) AS matched,
                 coalesce(list(term ORDER BY rank) FILTER (NOT in_doc AND weight >= 4.0), []) AS heavy
               FROM matches GROUP BY doc_id, posting_id""",
        ),
    ]


def with_sql(steps: list[tuple[str, str]], select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in steps) + "\n" + select


_DOCS = [("d_src", "SELECT doc_id, text FROM documents")]
_POST = [("p_src", tb.POSTINGS)]
_CVPOST = [("p_src", tb.DUCKDB.render(tb.CV_POSTINGS))]
_BOTH = [("p_src", "SELECT -1 - item_id AS posting_id, text FROM benchmark UNION ALL " + tb.DUCKDB.render(tb.CV_POSTINGS))]
_DOC_REQUESTS = "SELECT DISTINCT doc_id, unnest([doc_id % n, (doc_id * 7 + 3) % n]) AS posting_id FROM documents, (SELECT count(*) AS n FROM benchmark)"
_CV_REQUESTS = """SELECT p_partkey % (SELECT count(*) FROM customer) AS doc_id, p_partkey AS posting_id FROM part
    UNION SELECT c_custkey, (c_custkey * 7 + 3) % (SELECT count(*) FROM part) FROM customer"""
_CV_MATCH = (
    _CVPOST
    + term_steps("p_src", "p_")
    + token_steps("docs", "doc_id", "d_")
    + [forms_step("d_")]
    + match_steps("p_", "d_", _CV_REQUESTS)
)



def best_sql(per: str, k: int) -> str:
    """The k best pairs of each ``per`` among all that share a form."""
    other = "posting_id" if per == "doc_id" else "doc_id"
    return f"""SELECT doc_id, posting_id, coverage, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY coverage DESC, {other}) AS rank FROM (
          SELECT m.doc_id, m.posting_id, round(CAST(sum(x.weight) AS DOUBLE) / CAST(any_value(w.total) AS DOUBLE), 4) AS coverage
          FROM (SELECT DISTINCT v.doc_id, t.posting_id, t.rank FROM d_forms v JOIN term_forms t ON v.form = t.form) m
          JOIN p_terms x ON x.posting_id = m.posting_id AND x.rank = m.rank
          JOIN (SELECT posting_id, sum(weight) AS total FROM p_terms GROUP BY posting_id) w ON w.posting_id = m.posting_id
          GROUP BY m.doc_id, m.posting_id)) WHERE rank <= {k}"""


_KW_FINDINGS = """SELECT c.*, s.skills_words > 0 AS has_skills FROM coverages c JOIN structure s ON c.doc_id = s.doc_id"""
_KW = [
    ("kw_base", _KW_FINDINGS),
    (
        "kw_findings",
        """SELECT doc_id, posting_id, 'keywords.low_coverage' AS rule_id, 'critical' AS severity, 45.0 AS penalty, missing[1:8][1:5] AS ev, NULL AS section FROM kw_base WHERE coverage < 0.35
        UNION ALL SELECT doc_id, posting_id, 'keywords.partial_coverage', 'warning', 20.0, missing[1:5], NULL FROM kw_base WHERE coverage >= 0.35 AND coverage < 0.6
        UNION ALL SELECT doc_id, posting_id, 'keywords.strong_coverage', 'positive', 0.0, matched[1:5], NULL FROM kw_base WHERE coverage >= 0.6
        UNION ALL SELECT doc_id, posting_id, 'keywords.critical_missing', 'warning', 15.0, heavy[1:5], NULL FROM kw_base WHERE len(heavy) > 0
        UNION ALL SELECT doc_id, posting_id, 'keywords.no_skills_section', 'warning', 12.0, [], 'skills' FROM kw_base WHERE NOT has_skills AND len(missing) > 0""",
    ),
    (
        "all_findings",
        """SELECT f.doc_id, r.posting_id, rule_id, category, severity, penalty FROM findings f JOIN requests r ON r.doc_id = f.doc_id
        UNION ALL SELECT doc_id, posting_id, rule_id, 'keywords', severity, CAST(penalty AS DOUBLE) FROM kw_findings""",
    ),
    (
        "all_scores",
        f"""SELECT doc_id, posting_id, sum(score * w) / 100.0 AS overall FROM (
            SELECT d.doc_id, d.posting_id, c.w, greatest(0.0, least(100.0, 100.0 - coalesce(sum(f.penalty), 0.0))) AS score
            FROM requests d CROSS JOIN (SELECT unnest({str_list([c for c, _ in lx.CATEGORY_WEIGHTS])}) AS category, unnest([{', '.join(str(w) for _, w in lx.CATEGORY_WEIGHTS)}]::DOUBLE[]) AS w) c
            LEFT JOIN all_findings f ON f.doc_id = d.doc_id AND f.posting_id = d.posting_id AND f.category = c.category GROUP BY d.doc_id, d.posting_id, c.category, c.w) GROUP BY doc_id, posting_id""",
    ),
    (
        "all_prios",
        f"""SELECT doc_id, posting_id, sum({round1('gain')} ORDER BY rank) AS gains FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id, posting_id ORDER BY gain DESC, {rank_case()}, -penalty, category, rule_id) AS rank
            FROM (SELECT *, penalty * {weight_case()} / 100.0 AS gain FROM all_findings WHERE severity <> 'positive' AND penalty > 0))
          WHERE rank <= 5 GROUP BY doc_id, posting_id""",
    ),
]

SQL: dict[str, str] = {
    "k1_k2_tokens": with_sql(
        _DOCS + token_steps("d_src", "doc_id", "d_"),
        """SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY piece_no) - 1 AS chunk_no, tokens
        FROM (SELECT doc_id, line_no, piece_no, string_agg(token, ' ' ORDER BY pos_no) AS tokens FROM d_raw_tokens GROUP BY doc_id, line_no, piece_no)""",
    ),
    "k3_noise_filter": with_sql(
        _DOCS + token_steps("d_src", "doc_id", "d_"),
        f"SELECT token, count(*) AS n FROM d_raw_tokens WHERE NOT {noise('token')} GROUP BY token",
    ),
    "k4_stem": with_sql(_DOCS + token_steps("d_src", "doc_id", "d_"), "SELECT token, stem FROM d_stems"),
    "k5_line_weight": with_sql(
        _CVPOST + term_steps("p_src", "p_"), "SELECT posting_id, line_no, CAST(w AS DOUBLE) AS line_weight FROM p_weights"
    ),
    "k6_k7_candidate_terms": with_sql(
        _BOTH + term_steps("p_src", "p_"), "SELECT posting_id, key, term, CAST(weight AS DOUBLE) AS weight FROM p_cands"
    ),
    "k8_s5_posting_terms": with_sql(
        _POST + term_steps("p_src", "p_"), "SELECT posting_id, rank, key, term, CAST(weight AS DOUBLE) AS weight FROM p_terms"
    ),
    "k9_document_forms": with_sql(
        _DOCS + token_steps("d_src", "doc_id", "d_") + [forms_step("d_")],
        "SELECT form, count(*) AS n_docs FROM d_forms GROUP BY form",
    ),
    "k10_j3_term_match": cv_sql(
        "docs",
        f"SELECT doc_id, posting_id, rank, term, CAST(weight AS DOUBLE) AS weight, in_doc, {joined('variants')} AS variants FROM matches",
        _CV_MATCH,
    ),
    "k11_coverage": with_sql(
        _DOCS + _POST + term_steps("p_src", "p_") + token_steps("d_src", "doc_id", "d_") + [forms_step("d_")]
        + match_steps("p_", "d_", _DOC_REQUESTS),
        f"SELECT doc_id, posting_id, coverage, matched_count, total_count, {joined('missing[1:8]')} AS top_missing FROM coverages",
    ),
    "k12_best_postings": cv_sql(
        "docs",
        best_sql("doc_id", 5),
        _CVPOST + term_steps("p_src", "p_") + token_steps("docs", "doc_id", "d_") + [forms_step("d_")] + spelled_steps("p_"),
    ),
    "k12_best_documents": with_sql(
        _DOCS + _POST + term_steps("p_src", "p_") + token_steps("d_src", "doc_id", "d_") + [forms_step("d_")] + spelled_steps("p_"),
        best_sql("posting_id", 10),
    ),
    "rules_keywords": cv_sql(
        "structure",
        f"SELECT doc_id, posting_id, rule_id, severity, CAST(penalty AS DOUBLE) AS penalty, {joined('ev')} AS evidence, section FROM kw_findings",
        _CV_MATCH + _KW[:2],
    ),
    "ag2_overall_with_posting": cv_sql(
        "findings",
        f"""SELECT s.doc_id, s.posting_id, overall, {band_case('overall')} AS band,
        {round1('least(100.0, overall + coalesce(gains, 0.0))')} AS projected_score
        FROM all_scores s LEFT JOIN all_prios p ON s.doc_id = p.doc_id AND s.posting_id = p.posting_id""",
        _CV_MATCH + _KW,
    ),
}
