"""Structured facts of a document: contact details, bullets and date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalens import lexicon as lx
from vitalens.functions import text as tx
from vitalens.functions.core import (
    NOT_WS,
    WB_LEFT,
    WB_RIGHT,
    WORD,
    Add,
    WS,
    built_once,
    empty_strings,
    first_of,
    let,
    let_struct,
    unnest,
    words_array,
)
from vitalens.operators import sections as sx

# --- fixed values: contact patterns ---------------------------------------------
EMAIL = (
    rf"(?:{WB_LEFT}[A-Za-z0-9_]|(?<=[{WORD}])[.%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{WB_RIGHT}"
)
PHONE = (
    rf"(?U)(?<![{WORD}.])(?:\+?[0-9]{{1,3}}[{WS}.-]?)?(?:\([0-9]{{2,4}}\)[{WS}.-]?|[0-9]{{2,4}}[{WS}.-])?"
    rf"[0-9]{{3}}[{WS}.-]?[0-9]{{3,4}}(?:[{WS}.-]?[0-9]{{2,4}})?(?![{WORD}])"
)
LINKEDIN = rf"(?i)(?:https?://)?(?:[a-z]{{2,3}}\.)?linkedin\.com/(?:in|pub)/[{WORD}\-%.]+"
GITHUB = rf"(?i)(?:https?://)?(?:www\.)?github\.com/[{WORD}\-.]+"
URL = rf"(?i)(?:https?://|www\.)[{WORD}\-.]+\.[a-z]{{2,}}(?:/[{WORD}\-./?%&=+#]*)?"
LOCATION = (
    rf"{WB_LEFT}[A-Z][a-zA-Z.'-]+(?:[ \t]+[A-Z][a-zA-Z.'-]+){{0,2}},[ \t]*(?:[A-Z]{{2,3}}|[A-Z][a-z]+){WB_RIGHT}"
)
HEADER_FALLBACK_LINES = 8

# --- fixed values: bullet and date patterns ----------------------------------------
BULLET = rf"(?dU)^{WS}*[•\-*‣▪◦]{WS}+(.+)$"
FIRST_WORD = rf"[{WORD}](?:[{WORD}'-]*[{WORD}])?"
_MONTH_NAMES = "|".join(sorted(lx.MONTHS, key=len, reverse=True))
_DATE = rf"(?:(?:{_MONTH_NAMES})\.?{WS}+)?(?:[0-9]{{1,2}}[/.-])?(?:19|20)[0-9]{{2}}"
_OPEN_END = "present|current|now|ongoing|to date"
# A date begins with a digit or a month: other places are passed over before any month is tried.
_DATE_START = "".join(sorted({m[0] for m in lx.MONTHS}))
DATE_RANGE = rf"(?iU)(?=[0-9{_DATE_START}])({_DATE}){WS}*(?:-|–|—|to|until|through){WS}*({_DATE}|{_OPEN_END})"


# --- contact -------------------------------------------------------------------------


def looks_like_name(line: Column) -> Column:
    """2-5 words, at most 60 characters, no digit, @ or |, every word capitalised."""
    s = tx.ustrip(line)
    return (
        (F.length(s) <= 60)
        & F.regexp_count(s, F.lit(rf"(?U){NOT_WS}+")).between(2, 5)
        & ~s.rlike(r"[\p{Nd}@|]")
        & s.rlike(r"\p{L}")
        & ~s.rlike(rf"(?U)(?:^|[{WS},])[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]")
    )


def _all_matches(text: Column, pattern: str, hint: Column) -> Column:
    """Every match, tried only where a cheap hint says one is possible."""
    return F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        empty_strings()
    )


def _first_match(text: Column, pattern: str, hint: Column) -> Column:
    return F.when(hint, F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")))


def may_hold_url(text: Column) -> Column:
    """A hint that costs less than the pattern."""
    return F.contains(text, F.lit("://")) | F.contains(F.lower(text), F.lit("www."))


def sensitive_terms(flat: Column) -> Column:
    """Personal-data terms contained in flattened text, then a marker for photo hints."""
    return let(
        flat,
        lambda t: F.concat(
            F.filter(words_array(lx.SENSITIVE_TERMS), lambda p: F.contains(t, p)),
            F.filter(
                words_array(["photo reference"]),
                lambda _: F.exists(words_array(lx.PHOTO_HINTS), lambda p: F.contains(t, p)),
            ),
        ),
    )


def header_of(text: Column, secs: Column) -> Column:
    """The header section, of which there is at most one, else the first lines of the text."""
    first = F.array_join(F.slice(tx.lines_of(text), 1, HEADER_FALLBACK_LINES), "\n")
    return F.coalesce(first_of(F.filter(secs, lambda s: s["name"] == "header"))["text"], first)


def header_has_email(header: Column) -> Column:
    """Whether contacts are read from the header alone, and not from the whole text."""
    return F.contains(header, F.lit("@")) & header.rlike(EMAIL)


def emails_of(scope: Column) -> Column:
    return F.array_distinct(_all_matches(scope, EMAIL, F.contains(scope, F.lit("@"))))


def phones_of(scope: Column, emails: Column) -> Column:
    """Phone numbers outside of e-mail addresses and links."""

    def found(t: Column) -> Column:
        bare = F.when(may_hold_url(t), F.regexp_replace(t, URL, " ")).otherwise(t)
        return F.array_distinct(
            F.filter(
                F.transform(_all_matches(bare, PHONE, t.rlike("[0-9]{3}")), tx.ustrip),
                lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(7, 15),
            )
        )

    return let(F.aggregate(emails, scope, lambda acc, e: F.replace(acc, e, F.lit(" "))), found)


def websites_of(scope: Column) -> Column:
    return F.array_distinct(
        F.filter(
            _all_matches(scope, URL, may_hold_url(scope)),
            lambda u: ~F.lower(u).rlike(r"linkedin\.com|github\.com"),
        )
    )


def name_of(header: Column) -> Column:
    return tx.ustrip(first_of(F.filter(tx.lines_of(header), looks_like_name)))


def location_of(header: Column, name: Column) -> Column:
    """The place in the first line of the header that holds one and is not the name."""
    line = let(
        name,
        lambda n: first_of(
            F.filter(
                tx.lines_of(header), lambda l: (n.isNull() | (tx.ustrip(l) != n)) & l.rlike(LOCATION)
            )
        ),
    )
    return F.regexp_extract(line, LOCATION, 0)


def _profile_link(text: Column, flat: Column, site: str, pattern: str) -> Column:
    return _first_match(text, pattern, F.contains(flat, F.lit(".com/")) & F.contains(flat, F.lit(site)))


CONTACT = ("name", "emails", "phones", "linkedin", "github", "websites", "location", "sensitive")


@built_once
def _contact_columns() -> tuple[dict[str, Column], ...]:
    """Contact details as columns of their own, so that what a caller does not read is pruned."""
    text, header, scope, flat = (F.col(c) for c in ("text", "_header", "_scope", "flat"))
    return (
        {"flat": tx.flatten_text(text), "_header": header_of(text, F.col("cuts"))},
        {"_scope": F.when(header_has_email(header), header).otherwise(text)},
        {"_name": name_of(header), "_emails": emails_of(scope)},
        {
            "_phones": phones_of(scope, F.col("_emails")),
            "_linkedin": _profile_link(text, flat, "linkedin.com/", LINKEDIN),
            "_github": _profile_link(text, flat, "github.com/", GITHUB),
            "_websites": websites_of(scope),
            "_location": location_of(header, F.col("_name")),
            "_sensitive": sensitive_terms(flat),
        },
    )


def with_contact(cut: DataFrame, add: Add = DataFrame.withColumns) -> DataFrame:
    for columns in _contact_columns():
        cut = add(cut, columns)
    return cut


# --- bullets ---------------------------------------------------------------------------


def bullets(text: Column, secs: Column) -> Column:
    """Array of (line_no, section, body, words, opener) for bullet lines below headings."""
    return described(bullet_lines(text, secs))


def bullet_lines(text: Column, secs: Column) -> Column:
    """Array of (line_no, section, body) for bullet lines below headings."""

    def scan(v: Column) -> Column:
        return F.flatten(
            F.transform(
                v["secs"],
                lambda s: F.filter(
                    F.transform(
                        F.slice(v["lines"], s["start_line"] + 1, s["end_line"] - s["start_line"]),
                        lambda l, i: F.struct(
                            (s["start_line"] + i).alias("line_no"),
                            s["name"].alias("section"),
                            F.when(
                                ((i > 0) | (s["name"] == "header")) & tx.first_char(l).isin(*"•-*‣▪◦"),
                                tx.ustrip(F.regexp_extract(l, BULLET, 1)),
                            ).alias("body"),
                        ),
                    ),
                    lambda b: F.length(b["body"]) > 3,
                ),
            )
        )

    return let_struct(scan, lines=tx.lines_of(text), secs=secs)


def described(lines: Column) -> Column:
    """Bullet lines with their number of words and first word."""
    return F.transform(
        lines,
        lambda b: F.struct(
            b["line_no"].alias("line_no"),
            b["section"].alias("section"),
            b["body"].alias("body"),
            tx.word_count(b["body"]).alias("words"),
            F.lower(F.regexp_extract(b["body"], FIRST_WORD, 0)).alias("opener"),
        ),
    )


def judged_bullets(all_bullets: Column) -> Column:
    """Work-section bullets when they are at least max(4, 40 %) of all, else every bullet."""
    return let_struct(
        lambda v: F.when(
            F.size(v["work"]) >= F.greatest(F.lit(4.0), F.size(v["every"]) * F.lit(0.4)), v["work"]
        ).otherwise(v["every"]),
        every=all_bullets,
        work=F.filter(all_bullets, lambda b: b["section"].isin(*lx.WORK_SECTIONS)),
    )


# --- date ranges ------------------------------------------------------------------------


def _month_number(token: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in lx.MONTHS.items() for x in kv])
    named = let(
        F.regexp_extract(token, rf"(?iU)^({_MONTH_NAMES})\.?{WS}", 1),
        lambda m: F.when(m != "", F.try_element_at(names, F.lower(m))),
    )
    numeric = let(
        F.regexp_extract(token, r"^([0-9]{1,2})[/.-]", 1), lambda n: F.when(n != "", n.cast("int"))
    )
    return F.when(
        token.rlike("^[0-9]"), let(numeric, lambda n: F.when(n.between(1, 12), n))
    ).otherwise(named)


def _year_number(token: Column) -> Column:
    # A cast that fails costs an error with its stack, so nothing else than digits is cast.
    year = F.regexp_extract(token, r"((?:19|20)[0-9]{2})$", 1)
    return let(year, lambda y: F.when(y != "", y.cast("int")))


def date_ranges(text: Column, secs: Column) -> Column:
    """Array of (line_no, section, raw, start_year, start_month, end_year, end_month, is_current).

    A range belongs to the section whose lines hold it, the heading line included.
    """

    def scan(v: Column) -> Column:
        raw = F.flatten(
            F.flatten(
                F.transform(
                    v["secs"],
                    lambda s: F.transform(
                        F.slice(v["lines"], s["start_line"] + 1, s["end_line"] - s["start_line"]),
                        lambda l, i: F.transform(
                            _all_matches(l, DATE_RANGE, (F.contains(l, F.lit("19")) | F.contains(l, F.lit("20"))) & l.rlike("(?:19|20)[0-9]{2}")),
                            lambda r: F.struct(
                                (s["start_line"] + i).alias("line_no"),
                                s["name"].alias("section"),
                                r.alias("raw"),
                                F.regexp_extract(r, DATE_RANGE, 1).alias("start"),
                                F.regexp_extract(r, DATE_RANGE, 2).alias("end"),
                            ),
                        ),
                    ),
                )
            )
        )
        return F.transform(
            raw,
            lambda r: F.struct(
                r["line_no"].alias("line_no"),
                r["section"].alias("section"),
                r["raw"].alias("raw"),
                _year_number(r["start"]).alias("start_year"),
                _month_number(r["start"]).alias("start_month"),
                _year_number(r["end"]).alias("end_year"),
                _month_number(r["end"]).alias("end_month"),
                r["end"].rlike(rf"(?i)^(?:{_OPEN_END})$").alias("is_current"),
            ),
        )

    return let_struct(scan, lines=tx.lines_of(text), secs=secs)


def work_ranges(ranges: Column) -> Column:
    """Ranges in work sections; every range when there is none."""
    return let_struct(
        lambda v: F.when(F.size(v["work"]) > 0, v["work"]).otherwise(v["every"]),
        every=ranges,
        work=F.filter(ranges, lambda r: r["section"].isin(*lx.WORK_SECTIONS)),
    )


# --- long tables ------------------------------------------------------------------------


@built_once
def doc_bullet_lines() -> Column:
    return bullet_lines(F.col("text"), F.col("cuts"))


@built_once
def doc_bullets() -> Column:
    return described(F.col("bullet_lines"))


@built_once
def doc_ranges() -> Column:
    return date_ranges(F.col("text"), F.col("cuts"))


def parse(docs: DataFrame, add: Add = DataFrame.withColumns) -> DataFrame:
    """Documents with ``flat`` text and nested ``secs``, ``contact``, ``bullet_lines``, ``bullets`` and ``ranges``.

    Each is a narrow expression; what a caller does not select is pruned.
    """
    cut = add(docs, {"cuts": sx.doc_cuts()})
    cut = with_contact(add(cut, {"secs": sx.counted(F.col("cuts"))}), add)
    contact = F.struct(*[F.col(f"_{c}").alias(c) for c in CONTACT])
    out = add(cut, {"contact": contact, "bullet_lines": doc_bullet_lines(), "ranges": doc_ranges()})
    out = add(out, {"bullets": doc_bullets()})
    return out.drop("cuts", "_header", "_scope", *[f"_{c}" for c in CONTACT])


def contacts_table(docs: DataFrame) -> DataFrame:
    found = with_contact(docs.withColumn("cuts", sx.doc_cuts()))
    return found.select("doc_id", *[F.col(f"_{c}").alias(c) for c in CONTACT])


def bullets_table(docs: DataFrame) -> DataFrame:
    return unnest(parse(docs), ["doc_id"], "bullets")


def date_ranges_table(docs: DataFrame) -> DataFrame:
    return unnest(parse(docs), ["doc_id"], "ranges", "range_no")
