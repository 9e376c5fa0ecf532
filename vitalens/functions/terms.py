"""Tokens, stems and noise words of keyword matching, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalens import lexicon as lx
from vitalens.functions.core import HSPACE, WB_LEFT, WB_RIGHT, let

# Terms never run across these: "SQL, Kafka" is two skills.  Other places are passed over by their first character.
CHUNK_BREAK = (
    rf"(?U)(?=[,;:|/()\[\]{{}}.aowi])(?:[,;:|/()\[\]{{}}]|\.{HSPACE}|{WB_LEFT}(?:and|or|with|in){WB_RIGHT})"
)
TOKEN = r"[A-Za-z][A-Za-z0-9+#./-]*"
BULLET_LINE = r"(?U)^\s*[•\-*]"


def normalise_token(token: Column) -> Column:
    """Lower case without trailing punctuation; names such as c++ and node.js stay whole."""
    return F.regexp_replace(F.lower(token), "[./-]+$", "")


def tokens_of(chunk: Column) -> Column:
    return F.filter(
        F.transform(F.regexp_extract_all(chunk, F.lit(TOKEN), F.lit(0)), normalise_token),
        lambda t: t != "",
    )


def chunks_of(line: Column) -> Column:
    """Array of token arrays within which two words may form a term."""
    return F.filter(
        F.transform(F.split(F.lower(line), CHUNK_BREAK), tokens_of), lambda ts: F.size(ts) > 0
    )


def text_chunks(text: Column) -> Column:
    """Like ``chunks_of`` for a whole text; terms never cross lines."""
    return F.filter(
        F.transform(F.split(F.lower(text), rf"\n|{CHUNK_BREAK}"), tokens_of),
        lambda ts: F.size(ts) > 0,
    )


def pairs_of(tokens: Column) -> Column:
    """Adjacent token pairs of one chunk, as structs (a, b)."""
    return let(
        tokens,
        lambda ts: F.zip_with(
            F.slice(ts, 1, F.greatest(F.size(ts) - 1, F.lit(0))),
            F.slice(ts, 2, F.size(ts)),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        ),
    )


def stem(token: Column) -> Column:
    """Collapse inflections so mentor, mentored and mentoring share a form."""
    n = F.length(token)

    def cut(chars: int) -> Column:
        return F.substr(token, F.lit(1), n - chars)

    def undoubled(base: Column) -> Column:
        return F.when(
            F.length(base) > 2, F.regexp_replace(base, r"([^lsz])\1$", "$1")
        ).otherwise(base)

    suffixed = (
        F.when(
            token.endswith("s"),
            F.when(token.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
            .when(token.rlike("[sxzhio]es$") & (n > 4), cut(2))
            .when(~token.endswith("ss"), cut(1))
            .otherwise(token),
        )
        .when(token.endswith("ing") & (n > 5), undoubled(cut(3)))
        .when(token.endswith("ed") & (n > 4), undoubled(cut(2)))
        .otherwise(token)
    )
    kept = (n <= 3) | token.isin(*lx.PROTECTED_TOKENS) | token.rlike("[^a-z]")
    return F.when(kept, token).otherwise(
        let(
            suffixed,
            lambda x: F.when(
                x.endswith("e") & (F.length(x) > 3), F.substr(x, F.lit(1), F.length(x) - 1)
            ).otherwise(x),
        )
    )


def term_key(term: Column) -> Column:
    """Matching key of a term: its words stemmed."""
    return F.array_join(F.transform(F.split(term, " "), stem), " ")


def is_noise(token: Column) -> Column:
    return (F.length(token) < 2) | token.isin(*lx.noise_words())


def line_weight(line: Column) -> Column:
    """2.5 for lines phrased as requirements, 1.6 for bullets, else 1."""
    markers = "|".join(lx.REQUIREMENT_MARKERS)
    return (
        F.when(F.lower(line).rlike(markers), F.lit("2.5"))
        .when(line.rlike(BULLET_LINE), F.lit("1.6"))
        .otherwise(F.lit("1.0"))
        .cast("decimal(18,4)")
    )


def alias_forms(term: Column) -> Column:
    """Every form under which a document may evidence a term: the term, its canonical
    name, that name's aliases, and the stems of all of them."""
    canonical_of = {a: c for c, aliases in lx.SKILL_ALIASES.items() for a in aliases}
    to_canonical = F.create_map(*[F.lit(x) for kv in canonical_of.items() for x in kv])
    aliases_of = F.create_map(
        *[
            x
            for c, aliases in lx.SKILL_ALIASES.items()
            for x in (F.lit(c), F.array(*[F.lit(a) for a in aliases]))
        ]
    )

    def forms(canonical: Column) -> Column:
        plain = F.concat(
            F.array(term, canonical),
            F.coalesce(F.try_element_at(aliases_of, canonical), F.array().cast("array<string>")),
        )
        return let(plain, lambda p: F.array_distinct(F.concat(p, F.transform(p, term_key))))

    return let(F.coalesce(F.try_element_at(to_canonical, term), term), forms)
