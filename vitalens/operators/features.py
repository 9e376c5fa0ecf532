"""Per-document features the rules read, as one struct built from nested arrays."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalens import lexicon as lx
from vitalens.functions import text as tx
from vitalens.functions.core import (
    WB_LEFT,
    WB_RIGHT,
    WORD,
    Add,
    WS,
    YEAR,
    built_once,
    first_of,
    let,
    let_struct,
    words_array,
)
from vitalens.operators import facts as fx
from vitalens.operators import sections as sx
from vitalens.operators import timeline as tl

# --- fixed values: patterns and limits -----------------------------------------------
_UNITS = (
    "user|customer|client|people|engineer|report|team|project|countries|market|store|account|"
    "ticket|request|transaction|record|hour|day|week|month|year|second|ms"
)
QUANTITY = (
    rf"(?iU)[0-9][0-9,.]*{WS}?%"
    rf"|[$£€¥₹]{WS}?[0-9]"
    rf"|{WB_LEFT}[0-9][0-9,.]*{WS}?(?:k|m|bn|million|billion|thousand){WB_RIGHT}"
    rf"|{WB_LEFT}[0-9]+(?:\.[0-9]+)?{WS}?x{WB_RIGHT}"
    rf"|{WB_LEFT}[0-9][0-9,.]*{WS}*(?:{_UNITS})"
    rf"|{WB_LEFT}(?:from|to|by|over|under|within|across){WS}+[0-9]"
    rf"|{WB_LEFT}[0-9]{{2,}}{WB_RIGHT}"
)
PAST_TENSE = rf"[{WORD}]ed(?![{WORD}])"
GERUND_START = rf"^[{WORD}]+ing(?![{WORD}])"
# Tokens are runs of word characters and apostrophes from a word character on.
PRONOUN = (
    rf"(?=['{''.join(sorted({w[0] for w in lx.FIRST_PERSON}))}])(?<![{WORD}'])'*+"
    rf"({'|'.join(map(re.escape, lx.FIRST_PERSON))})(?![{WORD}'])"
)
# Most characters are ASCII and are passed over before the rest of the class is tried.
EXOTIC = rf"(?U)[^\x00-\x7F](?<![\xC0-\x{{24F}}•–—’“”{WS}])"
CAPS_RUN = rf"(?U)[A-Z](?<![{WORD}][A-Z])[A-Z]{{3,}}(?:{WS}+[A-Z]{{2,}}){{2,}}{WB_RIGHT}"
LONG_BULLET_WORDS = 34
SHORT_BULLET_WORDS = 6
LONG_LINE_CHARS = 130
TENSE_SAMPLE = 6


def is_quantified(body: Column) -> Column:
    """Holds a meaningful number once years are blanked."""
    return body.rlike("[0-9]") & F.regexp_replace(body, YEAR, " ").rlike(QUANTITY)


def verb_hint(body: Column) -> Column:
    """Strong verbs to suggest for a weak bullet, by topic."""
    hints = lx.verb_hints()

    def pick(low: Column) -> Column:
        out = None
        for group, cues in lx.VERB_TOPICS:
            hit = low.rlike("|".join(cues))
            out = F.when(hit, hints[group]) if out is None else out.when(hit, hints[group])
        return out.otherwise(hints["achievement"])

    return let(F.lower(body), lambda low: F.when(low.isNotNull(), pick(low)))


def phrase_hits(flat: Column, phrases: list[str], word_boundary: bool = False) -> Column:
    """Phrases contained in flattened text, in list order.

    Plain containment by default, so "photo" also hits "photography";
    ``word_boundary`` asks for whole words.
    """
    if word_boundary:
        return let(
            flat,
            lambda t: F.filter(
                words_array(phrases),
                lambda p: F.rlike(
                    t, F.concat(F.lit(rf"(?<![{WORD}])\Q"), p, F.lit(rf"\E(?![{WORD}])"))
                ),
            ),
        )
    return let(flat, lambda t: F.filter(words_array(phrases), lambda p: F.contains(t, p)))


def pronoun_hits(flat: Column) -> Column:
    """First-person pronoun tokens in text order, repeats kept."""
    return F.regexp_extract_all(flat, F.lit(PRONOUN), F.lit(1))


def judge(bullets: Column) -> Column:
    """Add the flags the impact rules read to each judged bullet."""
    return F.transform(
        bullets,
        lambda b: F.struct(
            b["line_no"].alias("line_no"),
            b["section"].alias("section"),
            b["body"].alias("body"),
            b["words"].alias("words"),
            b["opener"].alias("opener"),
            is_quantified(b["body"]).alias("quantified"),
            b["opener"].isin(*lx.WEAK_OPENERS).alias("weak"),
            b["opener"].isin(*lx.strong_verbs()).alias("strong"),
        ),
    )


def top_opener(bullets: Column) -> Column:
    """(opener, n) used most often, first seen on ties; null without openers.

    Openers are counted by one sort of the bullets and one pass over them.
    """

    def step(acc: Column, x: Column) -> Column:
        same = acc["opener"] == x["opener"]
        n = F.when(same, acc["n"] + 1).otherwise(1)
        first = F.when(same, acc["first"]).otherwise(x["seq"])
        better = (n > acc["best_n"]) | ((n == acc["best_n"]) & (first < acc["best_first"]))
        return F.struct(
            x["opener"].alias("opener"),
            n.alias("n"),
            first.alias("first"),
            F.when(better, x["opener"]).otherwise(acc["best"]).alias("best"),
            F.when(better, n).otherwise(acc["best_n"]).alias("best_n"),
            F.when(better, first).otherwise(acc["best_first"]).alias("best_first"),
        )

    ordered = F.array_sort(
        F.filter(
            F.transform(
                bullets, lambda b, i: F.struct(b["opener"].alias("opener"), i.alias("seq"))
            ),
            lambda x: x["opener"] != "",
        )
    )
    text, num = F.lit(None).cast("string"), F.lit(0)
    start = F.struct(
        text.alias("opener"),
        num.alias("n"),
        num.alias("first"),
        text.alias("best"),
        num.alias("best_n"),
        num.alias("best_first"),
    )
    return F.aggregate(
        ordered,
        start,
        step,
        lambda acc: F.struct(acc["best"].alias("opener"), acc["best_n"].alias("n")),
    )


def line_stats(text: Column) -> Column:
    """Struct of total, filled and overlong line counts."""
    return let(
        tx.lines_of(text),
        lambda ls: F.struct(
            F.size(ls).alias("lines"),
            F.size(F.filter(ls, lambda l: ~tx.is_blank(l))).alias("filled"),
            F.size(
                F.filter(ls, lambda l: (F.length(l) > LONG_LINE_CHARS) & ~tx.is_blank(l))
            ).alias("overlong"),
        ),
    )


def exotic_characters(text: Column) -> Column:
    """(n, sample): characters outside the usual set and the first ten distinct ones."""
    return let(
        F.regexp_extract_all(text, F.lit(EXOTIC), F.lit(0)),
        lambda xs: F.struct(
            F.size(xs).alias("n"),
            F.array_join(F.slice(F.array_distinct(xs), 1, 10), "").alias("sample"),
        ),
    )


def _bodies(bullets: Column, keep) -> Column:
    return F.transform(F.filter(bullets, keep), lambda b: b["body"])


def _count(bullets: Column, keep) -> Column:
    return F.size(F.filter(bullets, keep))


def bullet_features(judged: Column) -> Column:
    def build(js: Column) -> Column:
        tense = F.slice(F.filter(js, lambda b: b["section"] == "experience"), 1, TENSE_SAMPLE)
        return F.struct(
            F.size(js).alias("bullets"),
            _count(js, lambda b: b["quantified"]).alias("quantified"),
            F.slice(_bodies(js, lambda b: ~b["quantified"]), 1, 3).alias("unquantified_bodies"),
            F.slice(_bodies(js, lambda b: b["quantified"]), 1, 2).alias("quantified_bodies"),
            _count(js, lambda b: b["weak"]).alias("weak"),
            F.slice(_bodies(js, lambda b: b["weak"]), 1, 4).alias("weak_bodies"),
            _count(js, lambda b: b["strong"]).alias("strong"),
            F.slice(_bodies(js, lambda b: ~b["strong"]), 1, 3).alias("not_strong_bodies"),
            _count(js, lambda b: b["words"] > LONG_BULLET_WORDS).alias("long"),
            F.slice(_bodies(js, lambda b: b["words"] > LONG_BULLET_WORDS), 1, 3).alias("long_bodies"),
            _count(js, lambda b: b["words"] < SHORT_BULLET_WORDS).alias("short"),
            F.slice(_bodies(js, lambda b: b["words"] < SHORT_BULLET_WORDS), 1, 3).alias(
                "short_bodies"
            ),
            F.size(tense).alias("tense_sample"),
            _count(tense, lambda b: b["body"].rlike(PAST_TENSE)).alias("past"),
            _count(tense, lambda b: b["body"].rlike(GERUND_START)).alias("gerund"),
            verb_hint(first_of(_bodies(js, lambda b: b["weak"]))).alias("verb_hint"),
        )

    return let(judged, build)


def pronoun_features(flat: Column) -> Column:
    return let(
        pronoun_hits(flat),
        lambda p: F.struct(
            F.size(p).alias("n"),
            F.slice(F.array_sort(F.array_distinct(p)), 1, 5).alias("sample"),
        ),
    )


IMPACT = (
    "bullets", "quantified", "unquantified_bodies", "quantified_bodies", "weak", "weak_bodies", "strong",
    "not_strong_bodies", "top_opener", "long", "long_bodies", "short", "short_bodies", "tense_sample",
    "past", "gerund", "fillers", "cliches", "pronouns", "verb_hint",
)


def structure_features(secs: Column) -> Column:
    def build(v: Column) -> Column:
        names = v["names"]
        headings = F.transform(
            F.filter(v["secs"], lambda s: s["heading"] != ""), lambda s: s["heading"]
        )
        return F.struct(
            F.array_distinct(names).alias("recognised"),
            *[sx.has_section(v["secs"], n).alias(f"has_{n}") for n in [*lx.REQUIRED_SECTIONS, "summary"]],
            *[
                F.array_position(names, n).cast("int").alias(f"{n}_at")
                for n in ("experience", "education", "summary")
            ],
            *[F.array_contains(names, n).alias(f"heads_{n}") for n in lx.REQUIRED_SECTIONS],
            F.filter(
                words_array(lx.LOW_VALUE_SECTIONS), lambda n: F.array_contains(names, n)
            ).alias("low_value"),
            F.coalesce(v["exp"]["word_count"], F.lit(0)).alias("experience_words"),
            F.aggregate(v["secs"], F.lit(0), lambda acc, s: acc + s["word_count"]).alias(
                "section_words"
            ),
            F.coalesce(v["skills"]["word_count"], F.lit(0)).alias("skills_words"),
            F.exists(
                words_array(lx.OBSOLETE_SKILLS), lambda p: F.contains(v["skills_flat"], p)
            ).alias("skills_obsolete"),
            F.filter(
                headings,
                lambda h: F.regexp_replace(F.lower(h), ":+$", "").isin(*lx.CREATIVE_HEADINGS),
            ).alias("creative"),
            F.transform(
                F.filter(v["secs"], lambda s: s["name"] == "unknown"), lambda s: s["heading"]
            ).alias("unlabelled"),
        )

    return let_struct(
        lambda v: let_struct(
            build,
            secs=v["secs"],
            names=sx.recognised_names(v["secs"]),
            exp=sx.largest_section(v["secs"], "experience"),
            skills=sx.largest_section(v["secs"], "skills"),
            skills_flat=tx.flatten_text(sx.largest_section(v["secs"], "skills")["text"]),
        ),
        secs=secs,
    )


def timeline_features(ranges: Column, today: date) -> Column:
    def build(v: Column) -> Column:
        months = tl.tenure_months(v["spans"])
        current = F.filter(v["ranges"], lambda r: r["is_current"])
        raws = lambda rs: F.slice(F.transform(rs, lambda r: r["raw"]), 1, 4)
        return F.struct(
            months.alias("months"),
            F.size(v["ranges"]).alias("ranges"),
            F.size(F.filter(v["ranges"], lambda r: r["start_month"].isNotNull())).alias(
                "with_month"
            ),
            F.size(current).alias("current"),
            raws(v["ranges"]).alias("raws"),
            raws(current).alias("current_raws"),
            tl.gaps(v["spans"]).alias("gaps"),
        )

    return let(
        ranges,
        lambda rs: let_struct(build, ranges=rs, spans=tl.spans(fx.work_ranges(rs), today)),
    )


def format_features(text: Column) -> Column:
    return let(
        text,
        lambda t: F.struct(
            line_stats(t).alias("line_stats"),
            exotic_characters(t).alias("exotic"),
            let(
                F.regexp_extract_all(t, F.lit(CAPS_RUN), F.lit(0)),
                lambda c: F.struct(F.size(c).alias("n"), F.slice(c, 1, 3).alias("sample")),
            ).alias("caps"),
        ),
    )


LAYOUT_DEFAULTS = {
    "page_count": None,
    "word_count": None,
    "table_count": 0,
    "image_count": 0,
    "multi_column_pages": 0,
    "has_header_footer_text": False,
    "is_scanned": False,
}


def layout_of(docs: DataFrame, words: Column | None = None) -> Column:
    """Layout struct with per-field defaults; counts missing from it are taken from the text, or from its given words."""
    declared = (
        set(docs.schema["layout"].dataType.fieldNames()) if "layout" in docs.columns else set()
    )

    def field(name: str, default: Column) -> Column:
        if name in declared:
            return F.coalesce(F.col("layout")[name], default).alias(name)
        return default.alias(name)

    return let(
        tx.word_count(F.col("text")) if words is None else words,
        lambda words: F.struct(
            field("word_count", words),
            field("page_count", tx.page_estimate(words)),
            *[
                field(n, F.lit(d))
                for n, d in LAYOUT_DEFAULTS.items()
                if n not in ("word_count", "page_count")
            ],
        ),
    )


@built_once
def _feature_columns(today: date) -> tuple[dict[str, Column], ...]:
    # Columns of their own: what a caller does not read is pruned, which Spark does not do inside of one struct.
    parts = {
        "top_opener": top_opener(F.col("chosen")),
        "fillers": phrase_hits(F.col("flat"), lx.FILLER_PHRASES),
        "cliches": phrase_hits(F.col("flat"), lx.CLICHE_PHRASES),
        "pronouns": pronoun_features(F.col("flat")),
    }
    return (
        {"chosen": fx.judged_bullets(F.col("bullets"))},
        {
            "judged": judge(F.col("chosen")),
            "structure": structure_features(F.col("secs")),
            "timeline": timeline_features(F.col("ranges"), today),
            "format": format_features(F.col("text")),
        },
        parts | {"judging": bullet_features(F.col("judged"))},
        {"impact": F.struct(*[F.col(n if n in parts else f"judging.{n}").alias(n) for n in IMPACT])},
    )


def profile(docs: DataFrame, today: date, add: Add = DataFrame.withColumns) -> DataFrame:
    """docs (doc_id, text[, layout]) with nested facts and features; no shuffle."""
    out = fx.parse(docs, add)
    # Two columns: who reads the sections as well has no need to count the words of the text again.
    out = add(out, {"layout": layout_of(docs), "sized": layout_of(docs, sx.total_words(F.col("secs")))})
    for columns in _feature_columns(today):
        out = add(out, columns)
    return out
