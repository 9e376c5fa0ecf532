"""Headings and sections: find heading lines and cut a document into sections.

Everything is a column expression over the document's own text, so a corpus is
sectioned without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalens import lexicon as lx
from vitalens.functions import text as tx
from vitalens.functions.core import NOT_WS, WS, YEAR, built_once, first_of, let, let_struct, unnest

SENTENCE_END = (".", ",", ";")
MAX_HEADING_WORDS = 5
MAX_HEADING_CHARS = 60
# More words than a heading may have, by the places where normalise_heading would part them.
WORDY = rf"(?sU)\A[^\p{{L}}\p{{N}}]*+[^{WS}&/]++(?:[{WS}&/]++[^{WS}&/]++){{{MAX_HEADING_WORDS - 1}}}[{WS}&/]++.*?[\p{{L}}\p{{N}}]"
# More words than a heading may have, as runs without spaces.
MANY_WORDS = rf"(?U)\A{WS}*+(?:{NOT_WS}++{WS}++){{{MAX_HEADING_WORDS}}}{NOT_WS}"

_RANKED = lx.synonym_ranking()
_ALTERNATIVES = "|".join(re.escape(p).replace(r"\ ", " ") for p, _ in _RANKED)


def normalise_heading(line: Column) -> Column:
    """Trim non-alphanumerics, lower case, treat & and / as spaces, collapse spaces."""
    edge = r"\A[^\p{L}\p{N}]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++\z"
    return F.regexp_replace(F.lower(F.regexp_replace(line, edge, "")), rf"(?U)[{WS}&/]+", " ")


def is_bullet(stripped: Column) -> Column:
    return F.substring(stripped, 1, 1).isin(*"•-*–—") & F.substring(stripped, 2, 1).isin(*tx.SPACES)


def ends_sentence(stripped: Column) -> Column:
    dot, comma, semicolon = (stripped.endswith(c) for c in SENTENCE_END)
    return dot | comma | semicolon


def _rank_map() -> Column:
    pairs = [F.lit(x) for i, (p, _) in enumerate(_RANKED) for x in (p, i)]
    return F.create_map(*pairs)


def heading_name(stripped: Column) -> Column:
    """Canonical section named by a stripped line, or null.

    An exact synonym wins; else a synonym at either end of the line, the longest
    first.
    """
    ranks = _rank_map()
    names = F.array(*[F.lit(c) for _, c in _RANKED])

    def lookup(n: Column) -> Column:
        rank = F.coalesce(
            F.try_element_at(ranks, n),
            F.least(
                F.try_element_at(ranks, F.regexp_extract(n, f"^({_ALTERNATIVES}) ", 1)),
                F.try_element_at(ranks, F.regexp_extract(n, f" ({_ALTERNATIVES})$", 1)),
            ),
        )
        return F.when(
            (n != "") & (F.size(F.split(n, " ")) <= MAX_HEADING_WORDS), F.get(names, rank)
        )

    prose = (
        is_bullet(stripped)
        | ends_sentence(stripped)
        | stripped.rlike(r"^[^\p{L}]*\p{Ll}")
        | stripped.rlike(WORDY)
    )
    return F.when(~prose, let(normalise_heading(stripped), lookup))


def heading_style(stripped: Column) -> Column:
    """'colon', 'caps' or 'title' for a heading-shaped stripped line, else null."""
    shaped = (
        (stripped != "")
        & (F.length(stripped) <= MAX_HEADING_CHARS)
        & ~is_bullet(stripped)
        & ~ends_sentence(stripped)
        & ~stripped.rlike(MANY_WORDS)
        & stripped.rlike(r"\p{L}")
        & ~stripped.rlike(rf"{YEAR}|[@|]")
    )
    letters = F.length(F.regexp_replace(stripped, r"\P{L}++", ""))
    upper = F.length(F.regexp_replace(stripped, r"\P{Lu}++", ""))
    return F.when(
        shaped,
        F.when(stripped.endswith(":"), F.lit("colon"))
        .when(upper / letters > 0.85, F.lit("caps"))
        .when(~stripped.rlike(rf"(?U)(?:^|{WS})[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]"), F.lit("title")),
    )


def heading_candidates(lines: Column) -> Column:
    """Array of (line_no, heading, after_blank, name, style) for lines that could be headings."""

    def scan(ls: Column) -> Column:
        # Most lines are bullets: they go before anything else is read of them.
        begun = F.filter(
            F.transform(
                ls, lambda l, i: F.struct(i.alias("line_no"), F.ltrim(l, F.lit(tx.SPACES)).alias("heading"))
            ),
            lambda x: (x["heading"] != "") & ~is_bullet(x["heading"]),
        )
        stripped = F.transform(
            begun,
            lambda x: F.struct(x["line_no"].alias("line_no"), tx.rstrip(x["heading"]).alias("heading")),
        )
        return F.transform(
            F.filter(stripped, lambda x: ~ends_sentence(x["heading"])),
            lambda x: F.struct(
                x["line_no"].alias("line_no"),
                x["heading"].alias("heading"),
                F.coalesce(tx.is_blank(F.get(ls, x["line_no"] - 1)), F.lit(False)).alias("after_blank"),
                heading_name(x["heading"]).alias("name"),
                heading_style(x["heading"]).alias("style"),
            ),
        )

    return let(lines, scan)


def _occurrences(array: Column, value: str) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def dominant_style(candidates: Column) -> Column:
    """Style most named headings share (first seen on ties), if it is caps or colon and used twice."""
    styles = F.transform(
        F.filter(candidates, lambda x: x["name"].isNotNull() & x["style"].isNotNull()),
        lambda x: x["style"],
    )

    def pick(ss: Column) -> Column:
        ranked = F.array_max(
            F.array(
                *[
                    F.struct(
                        _occurrences(ss, k).alias("n"),
                        (-F.array_position(ss, F.lit(k))).alias("first"),
                        F.lit(k).alias("style"),
                    )
                    for k in ("caps", "colon", "title")
                ]
            )
        )
        return let(
            ranked, lambda r: F.when((r["n"] >= 2) & (r["style"] != "title"), r["style"])
        )

    return let(styles, pick)


def boundaries(candidates: Column, unnamed_after: str = "nonblank") -> Column:
    """Heading lines that start a section: named ones, and unnamed ones in the dominant style.

    ``unnamed_after`` says which predecessor line an unnamed heading needs:
    'nonblank' (default) or 'blank'.
    """
    wants_blank = F.lit(unnamed_after == "blank")

    def pick(v: Column) -> Column:
        return F.filter(
            v["cands"],
            lambda x: x["name"].isNotNull()
            | (
                (x["style"] == v["style"])
                & (x["line_no"] > 0)
                & (x["after_blank"] == wants_blank)
            ),
        )

    return let(
        candidates, lambda c: let_struct(pick, cands=c, style=dominant_style(c))
    )


def cuts(text: Column, unnamed_after: str = "nonblank") -> Column:
    """Sections in document order: (sec_no, name, heading, start_line, end_line, text).

    Lines above the first heading form the section 'header'; ``end_line`` is exclusive.
    """

    def spans(v: Column) -> Column:
        n = F.size(v["lines"])
        header = F.filter(
            F.array(
                F.struct(
                    F.lit("header").alias("name"),
                    F.lit("").alias("heading"),
                    F.lit(0).alias("start_line"),
                    F.coalesce(first_of(v["bounds"])["line_no"], n).alias("end_line"),
                    F.lit(0).alias("body_line"),
                )
            ),
            lambda h: h["end_line"] > 0,
        )
        named = F.transform(
            v["bounds"],
            lambda b, i: F.struct(
                F.coalesce(b["name"], F.lit("unknown")).alias("name"),
                b["heading"].alias("heading"),
                b["line_no"].alias("start_line"),
                F.coalesce(F.get(v["bounds"], i + 1)["line_no"], n).alias("end_line"),
                (b["line_no"] + 1).alias("body_line"),
            ),
        )

        def body(s: Column) -> Column:
            # The blank line before the next heading goes with its line break: trimming one reads the whole text.
            last = F.get(v["lines"], s["end_line"] - 1) == ""
            n = s["end_line"] - s["body_line"]
            return tx.ustrip(
                F.array_join(F.slice(v["lines"], s["body_line"] + 1, F.when(last & (n > 0), n - 1).otherwise(n)), "\n")
            )

        return F.transform(
            F.concat(header, named),
            lambda s, i: F.struct(
                i.alias("sec_no"),
                s["name"].alias("name"),
                s["heading"].alias("heading"),
                s["start_line"].alias("start_line"),
                s["end_line"].alias("end_line"),
                body(s).alias("text"),
            ),
        )

    return let(
        tx.lines_of(text),
        lambda ls: let_struct(
            spans, lines=ls, bounds=boundaries(heading_candidates(ls), unnamed_after)
        ),
    )


def counted(found: Column) -> Column:
    """Cut sections with their word_count."""
    return F.transform(
        found,
        lambda s: F.struct(
            s["sec_no"].alias("sec_no"),
            s["name"].alias("name"),
            s["heading"].alias("heading"),
            s["start_line"].alias("start_line"),
            s["end_line"].alias("end_line"),
            s["text"].alias("text"),
            tx.word_count(s["text"]).alias("word_count"),
        ),
    )


def sections(text: Column, unnamed_after: str = "nonblank") -> Column:
    """Sections in document order: (sec_no, name, heading, start_line, end_line, text, word_count)."""
    return counted(cuts(text, unnamed_after))


def largest_section(secs: Column, name: str) -> Column:
    """The section of this name with most words (first on ties), or null."""
    best = F.array_max(
        F.transform(
            F.filter(secs, lambda s: s["name"] == name),
            lambda s: F.struct(
                s["word_count"].alias("n"), (-s["sec_no"]).alias("first"), s.alias("s")
            ),
        )
    )
    return best["s"]


def has_section(secs: Column, name: str) -> Column:
    return F.exists(secs, lambda s: (s["name"] == name) & (s["word_count"] > 0))


def total_words(secs: Column) -> Column:
    """Words of the whole text, from its counted sections and their headings: no word spans two lines."""
    return F.aggregate(secs, F.lit(0), lambda n, s: n + s["word_count"] + tx.word_count(s["heading"]))


def recognised_names(secs: Column) -> Column:
    """Names of recognised sections in document order, repeats kept."""
    return F.transform(
        F.filter(secs, lambda s: ~s["name"].isin("header", "unknown")), lambda s: s["name"]
    )


# --- long tables ---------------------------------------------------------------


@built_once
def doc_cuts() -> Column:
    """Sections of the column ``text`` without their numbers of words."""
    return cuts(F.col("text"))


@built_once
def doc_sections(unnamed_after: str = "nonblank") -> Column:
    """Sections of the column ``text``."""
    return sections(F.col("text"), unnamed_after)


@built_once
def _doc_headings() -> Column:
    return F.filter(
        heading_candidates(tx.lines_of(F.col("text"))),
        lambda x: x["name"].isNotNull() | x["style"].isNotNull(),
    )


@built_once
def _doc_dominant_style() -> Column:
    return dominant_style(heading_candidates(tx.lines_of(F.col("text"))))


@built_once
def _doc_largest_sections() -> Column:
    return let(
        doc_sections(),
        lambda secs: F.transform(
            F.array_distinct(F.transform(secs, lambda s: s["name"])),
            lambda n: F.array_max(
                F.transform(
                    F.filter(secs, lambda s: s["name"] == n),
                    lambda s: F.struct(
                        s["word_count"].alias("word_count"),
                        (-s["sec_no"]).alias("neg_no"),
                        s["name"].alias("name"),
                        s["heading"].alias("heading"),
                        s["start_line"].alias("start_line"),
                    ),
                )
            ),
        ),
    )


def lines_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line)"""
    return docs.select("doc_id", F.posexplode(tx.lines_of(F.col("text"))).alias("line_no", "line"))


def match_headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, heading, name, style) for every heading-shaped or named line."""
    return unnest(docs, ["doc_id"], _doc_headings()).drop("after_blank")


def dominant_styles(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _doc_dominant_style().alias("style"))


def sections_table(docs: DataFrame, unnamed_after: str = "nonblank") -> DataFrame:
    return unnest(docs, ["doc_id"], doc_sections(unnamed_after))


def largest_sections(docs: DataFrame) -> DataFrame:
    """One row per (doc_id, name): the largest section of that name."""
    return unnest(docs, ["doc_id"], _doc_largest_sections()).drop("neg_no")
