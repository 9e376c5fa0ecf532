"""Comparison of reviews: what was resolved, introduced and is still open, and how scores moved.

A review travels as one card: its overall score, its category scores as a map, and its open
rules as bit masks, one for each severity.  A pair of reviews meets two cards of a few hundred
bytes, and the differences are bit operations on the row; findings are not joined with each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalens import lexicon as lx
from vitalens.functions.core import let, let_struct, round1, unnest

WORD_BITS = 63  # a mask word stays a positive bigint
OPEN_SEVERITIES = tuple(s for s in lx.SEVERITY_RANK if s != "positive")


@dataclass(frozen=True)
class RuleBits:
    """The place of each rule in the masks: all rules of a catalogue, by id."""

    rule_ids: tuple[str, ...]

    @staticmethod
    def of(*catalogues) -> RuleBits:
        return RuleBits(tuple(sorted({r.rule_id for c in catalogues for r in c.rules})))

    @property
    def words(self) -> int:
        return -(-len(self.rule_ids) // WORD_BITS)

    def place(self, rule_id: Column) -> Column:
        """Number of a rule; a rule that is not in the catalogue is an error, not a lost finding."""
        places = F.create_map(*[F.lit(x) for place, r in enumerate(self.rule_ids) for x in (r, place)])
        unknown = F.raise_error(F.concat(F.lit("rule without a bit: "), rule_id)).cast("int")
        return F.coalesce(F.try_element_at(places, rule_id), unknown)

    def table(self) -> Column:
        """All rules as an array of (rule_id, word, bit), by id."""
        return F.array(
            *[
                F.struct(F.lit(r).alias("rule_id"), F.lit(p // WORD_BITS).alias("word"), F.lit(1 << p % WORD_BITS).cast("bigint").alias("bit"))
                for r, p in sorted((r, p) for p, r in enumerate(self.rule_ids))
            ]
        )


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place % WORD_BITS)


def _word(place: Column) -> Column:
    return F.floor(place / WORD_BITS).cast("int")


def review_cards(reviews: DataFrame, findings: DataFrame, scores: DataFrame, bits: RuleBits) -> DataFrame:
    """Cards (review_id, overall, scores, open) of stored reviews from their long tables.

    The three tables take one shape, so that one shuffle brings all of a review together and
    partial aggregates go before it.  ``scores`` maps the applicable categories; ``open`` holds an
    array of mask words for each severity but positive.
    """
    place = bits.place(F.col("rule_id"))
    rows = (
        reviews.select("review_id", F.lit(True).alias("known"), F.col("overall").cast("double").alias("overall"))
        .unionByName(
            findings.filter(F.col("severity") != "positive").select(
                "review_id", "severity", _word(place).alias("word"), _bit(place).alias("bit")
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            scores.filter("applicable").select(
                "review_id", F.struct("category", F.col("score").cast("double").alias("score")).alias("scored")
            ),
            allowMissingColumns=True,
        )
    )
    masks = {
        f"{s}_{w}": F.bit_or(F.when((F.col("severity") == s) & (F.col("word") == w), F.col("bit")).otherwise(F.lit(0).cast("bigint")))
        for s in OPEN_SEVERITIES
        for w in range(bits.words)
    }
    cards = rows.groupBy("review_id").agg(
        F.max("known").alias("known"),
        F.max("overall").alias("overall"),
        F.map_from_entries(F.collect_list("scored")).alias("scores"),
        *[m.alias(n) for n, m in masks.items()],
    )
    open_ = F.struct(*[F.array(*[F.col(f"{s}_{w}") for w in range(bits.words)]).alias(s) for s in OPEN_SEVERITIES])
    return cards.filter("known").select("review_id", "overall", "scores", open_.alias("open"))


def card_columns(bits: RuleBits) -> dict[str, Column]:
    """``scores`` and ``open`` of a card from columns findings and category_scores of a fresh review."""

    def masks(fs: Column) -> Column:
        def word(severity: str, w: int) -> Column:
            own = F.filter(fs, lambda f: (f["severity"] == severity) & (_word(f["place"]) == w))
            return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, f: acc.bitwiseOR(_bit(f["place"])))

        return F.struct(*[F.array(*[word(s, w) for w in range(bits.words)]).alias(s) for s in OPEN_SEVERITIES])

    placed = F.transform(
        F.filter("findings", lambda f: f["severity"] != "positive"),
        lambda f: F.struct(f["severity"].alias("severity"), bits.place(f["rule_id"]).alias("place")),
    )
    used = F.transform(
        F.filter("category_scores", lambda c: c["applicable"]), lambda c: F.struct(c["category"], c["score"].cast("double"))
    )
    return {"scores": F.map_from_entries(used), "open": let(placed, masks)}


def _any(open_: Column) -> Column:
    """Mask words of open rules of any severity."""
    out = open_[OPEN_SEVERITIES[0]]
    for s in OPEN_SEVERITIES[1:]:
        out = F.zip_with(out, open_[s], lambda a, b: a.bitwiseOR(b))
    return out


def _without(words: Column, other: Column) -> Column:
    return F.zip_with(words, other, lambda a, b: a.bitwiseAND(F.bitwise_not(b)))


def compare(pairs: DataFrame, cards: DataFrame, bits: RuleBits) -> DataFrame:
    """One row per pair (review_id, baseline_id) of reviews that have cards.

    overall_delta; categories (category, current, baseline, delta) both are scored on; resolved,
    introduced and still_open, arrays of (rule_id, severity) by id.  The severity is the one of
    the review in which the rule is open, for still_open the current one, and the worst if a review
    holds several findings of a rule.
    """
    names = [c for c in cards.columns if c != "review_id"]
    now = cards.select("review_id", F.struct(*names).alias("now"))
    before = cards.select(F.col("review_id").alias("baseline_id"), F.struct(*names).alias("before"))

    def named(open_: Column, words: Column) -> Column:
        """The rules whose bits are set in ``words``, with their severity in ``open_``."""

        def severity(r: Column) -> Column:
            out = None
            for s in OPEN_SEVERITIES:
                held = F.get(open_[s], r["word"]).bitwiseAND(r["bit"]) != 0
                out = F.when(held, s) if out is None else out.when(held, s)
            return out

        chosen = F.filter(bits.table(), lambda r: F.get(words, r["word"]).bitwiseAND(r["bit"]) != 0)
        return F.transform(chosen, lambda r: F.struct(r["rule_id"].alias("rule_id"), severity(r).alias("severity")))

    def differences(v: Column) -> Column:
        old, new = v["old"], v["new"]
        both = F.zip_with(new, old, lambda a, b: a.bitwiseAND(b))
        return F.struct(
            named(v["before"]["open"], _without(old, new)).alias("resolved"),
            named(v["now"]["open"], _without(new, old)).alias("introduced"),
            named(v["now"]["open"], both).alias("still_open"),
        )

    def moved(c: Column) -> Column:
        cur, base = F.col("now.scores")[c], F.col("before.scores")[c]
        return F.struct(c.alias("category"), round1(cur).alias("current"), round1(base).alias("baseline"), round1(cur - base).alias("delta"))

    shared = F.array_sort(F.array_intersect(F.map_keys("now.scores"), F.map_keys("before.scores")))
    diff = let_struct(
        differences, now=F.col("now"), before=F.col("before"), new=_any(F.col("now.open")), old=_any(F.col("before.open"))
    )
    met = pairs.join(now, "review_id").join(before, "baseline_id")
    return met.select(
        "review_id",
        "baseline_id",
        round1(F.col("now.overall") - F.col("before.overall")).alias("overall_delta"),
        F.transform(shared, moved).alias("categories"),
        diff.alias("diff"),
    ).select("review_id", "baseline_id", "overall_delta", "categories", "diff.*")


def finding_diff(compared: DataFrame) -> DataFrame:
    """(review_id, baseline_id, rule_id, severity, change) with change resolved, introduced or still_open."""
    def labelled(change: str) -> Column:
        return F.transform(
            change, lambda r: F.struct(r["rule_id"].alias("rule_id"), r["severity"].alias("severity"), F.lit(change).alias("change"))
        )

    every = F.concat(*[labelled(c) for c in ("resolved", "introduced", "still_open")])
    return unnest(compared, ["review_id", "baseline_id"], every)


def category_deltas(compared: DataFrame) -> DataFrame:
    """(review_id, baseline_id, category, current, baseline, delta)"""
    return unnest(compared, ["review_id", "baseline_id"], "categories")
