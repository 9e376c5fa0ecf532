"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated at most `max_epochs` times.  A budget of
words is shared by weight; sources whose share is above their cap are clamped to it, and
what they leave is shared again among the others by weight, until no share is above its
cap.  One round is one aggregate over the sources, so their number is not bounded.

A source's target, rounded to words, is then filled by whole passes over all of its
documents and one fractional pass: documents in the order of a seeded key, until the words
of the target are reached.  The document in which that happens is taken in part, so that
a source's words equal its rounded target.  The place of that document is found by
narrowing the key, LEVELS times BITS bits, with sums per stretch of keys; no task orders the
documents of a source.  The key depends on seed, id and text alone, so reruns agree.

All of it is DataFrame functions; sums and shares are exact integers.

Null and empty texts have size 0 and nothing is taken of them.  A null source is a source
of its own, the last in order.  Rows that share id and text share their key; where the
fractional pass ends among them, each gives its share, rounded down.  An empty table gives
no rows.  If all sources together allow less than the budget, each is taken to its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalens.llm.common import numbered, saved

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, 17
LEVELS, BITS = 4, 12
WORD = r"[^\x20\x09-\x0D]+"


def whole(x) -> Column:
    """An integer that products of word counts and weights do not overflow."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(38,0)")


def quotient(a: Column, b: Column) -> Column:
    """a / b, rounded down, of integers from 0 on; null where b is 0."""
    return F.call_function("div", a, F.nullif(b, whole(0)))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def key_of(id_col: Column, text: Column, seed: int) -> Column:
    """A seeded number of LEVELS * BITS bits, from id and text."""
    spelled = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(spelled), 1, LEVELS * BITS // 4), 16, 10).cast("bigint")


def cycled(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, ...) with weight: the given ones in turn, by the code points of the names, null last."""
    placed = numbered(sources, [F.col("source").asc_nulls_last()], "place")
    turn = F.get(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights))
    return placed.withColumn("weight", turn.cast("bigint")).drop("place")


def water_filled(sources: DataFrame, budget: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size, weight) with target, a double, and words, the target as an integer."""
    cap, weight = whole(F.col("source_size")) * whole(max_epochs), whole(F.col("weight"))
    clamped, left, shared = F.lit(False), budget, None
    while True:
        found = sources.agg(F.sum(F.when(clamped, cap).otherwise(whole(0))).alias("caps"), F.sum(F.when(clamped, whole(0)).otherwise(weight)).alias("weights")).first()
        # The level of the others only rises, so what is clamped once stays so.
        if (budget - int(found.caps or 0), int(found.weights or 0)) == (left, shared):
            break
        left, shared = budget - int(found.caps or 0), int(found.weights or 0)
        clamped = cap * whole(shared) < whole(left) * weight if shared else F.lit(True)
    share = whole(left) * weight
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share.cast("double") / F.lit(float(shared or 1)))).withColumn(
        "words", F.when(clamped, cap.cast("bigint")).otherwise(quotient(whole(2) * share + whole(shared), whole(2 * (shared or 1))))
    )


def filled_to(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where a pass over the documents of a source, by key, has given the words wanted of it.

    sized (source, size, key), wanted (source, need): rows (source, key, need, tie), the key
    of the last document, the words that are missing before it, and the words of that key.
    """
    at = wanted.where("need > 0").select("source", "need", F.lit(0).cast("bigint").alias("prefix"))
    for level in range(1, LEVELS + 1):
        below = BITS * (LEVELS - level)
        asked = at.select(F.col("source").alias("asked"), "need", "prefix")
        inside = sized.join(asked, F.col("source").eqNullSafe(F.col("asked"))).where(F.shiftright("key", below + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "need", F.shiftright("key", below).alias("prefix")).agg(F.sum("size").alias("tie"))
        # At most 2^BITS rows of a source.
        upto = sums.withColumn("upto", F.sum("tie").over(Window.partitionBy("source").orderBy("prefix")))
        before = F.col("upto") - F.col("tie")
        at = saved(upto.where((before < F.col("need")) & (F.col("need") <= F.col("upto"))).select("source", (F.col("need") - before).alias("need"), "prefix", "tie"))
    return at.withColumnRenamed("prefix", "key")


def planned(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """One row per source of sized (source, size, key): its size, target and how it is filled.

    The budget is `share` times all words, rounded down.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = saved(cycled(sources, weights))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = total if share == 1.0 else int(total * share)
    filled = saved(water_filled(sources, budget, max_epochs))
    passes = F.coalesce(quotient(F.col("words"), F.nullif("source_size", F.lit(0))), F.lit(0))
    filled = filled.withColumn("passes", passes).withColumn("need", F.col("words") - F.col("passes") * F.col("source_size"))
    ends = filled_to(sized, filled.select("source", "need"))
    ends = ends.select(F.col("source").alias("end_source"), F.col("key").alias("end_key"), F.col("need").alias("end_need"), F.col("tie").alias("end_tie"))
    plan = filled.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left").drop("end_source", "need", "words")
    return saved(plan.withColumnRenamed("source", "plan_source"))


def filled(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized (source, size, key, ...) with source_size, target, passes and extra, the words of the fractional pass."""
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    part = quotient(whole(F.col("end_need")) * whole(F.col("size")), whole(F.col("end_tie")))
    extra = F.when(F.col("key") < F.col("end_key"), F.col("size")).when(F.col("key") == F.col("end_key"), part).otherwise(0)
    return joined.withColumn("extra", extra.cast("bigint")).withColumn("taken", F.col("passes") * F.col("size") + F.col("extra")).drop("plan_source", "end_key", "end_need", "end_tie", "weight")


def mixed(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    share: float = 1.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, passes, extra, taken."""
    sized = saved(_sized(df, seed, id_col, text_col, source_col).drop("row"))
    out = filled(sized, planned(sized, weights, max_epochs, share))
    return out.select("doc_id", "source", "size", "source_size", "target", "passes", "extra", "taken")


def mixture(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    share: float = 1.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: a row for each copy, of row (all columns, as they came), copy (from 1) and text.

    The one document of a source that is taken in part has its first words as last copy.
    """
    rows = _sized(df, seed, id_col, text_col, source_col)
    out = filled(rows, planned(saved(rows.drop("row")), weights, max_epochs, share))
    copies = F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)
    out = out.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    text = F.col("row").getField(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("extra").cast("int")), " ")
    return out.select("row", "copy", F.when((F.col("copy") > F.col("passes")) & (F.col("extra") < F.col("size")), cut).otherwise(text).alias("text"))


def _sized(df: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = df[text_col].cast("string")
    return df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"),
        df[id_col].alias("doc_id"),
        df[source_col].cast("string").alias("source"),
        size_of(text).alias("size"),
        key_of(df[id_col], text, seed).alias("key"),
    )
