"""Building blocks for per-document column expressions.

The scoring job keeps one row per document and works on nested arrays, so it
needs no shuffle.  ``let`` names an intermediate value inside such an
expression: the optimizer may inline a projected column into a lambda, where it
would be evaluated once per array element, whereas a value bound by ``let`` is
evaluated exactly once per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every pattern that uses these starts with the (?U) flag, under which \s and \S
# follow the Unicode white-space property.  Words are letters, numbers and
# underscore (under (?U), \w would also take combining marks).
WS = r"\s"
NOT_WS = r"\S"
HSPACE = r"[^\S\n]"
WORD = r"\p{L}\p{N}_"
# Word boundaries for that class, before and after a word character.
WB_LEFT = rf"(?<![{WORD}])"
WB_RIGHT = rf"(?![{WORD}])"
YEAR = rf"(?:19|20)[0-9]{{2}}(?<![{WORD}][0-9]{{4}}){WB_RIGHT}"


# Column trees over fixed column names are built once per process: each node costs
# a round trip to the JVM, and a scoring plan has thousands of nodes.
built_once = lru_cache(maxsize=None)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_struct(body: Callable[[Column], Column], **values: Column) -> Column:
    """Like ``let`` for several values; ``body`` receives a struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def is_sound(value: Column) -> Column:
    """Whether ``value`` can be computed at all: false where its evaluation raises an error.

    Every part of the value is evaluated (it is hashed) as the argument of a ``try_``
    function, which turns an error anywhere below it into null.  This stands inside ``let``, out
    of which Spark moves no common parts of expressions; else one could raise outside of the
    ``try_``.  Errors of Python functions are not caught, as these run outside of the expression.
    """
    probe = F.try_to_binary(F.xxhash64(value).cast("string"), F.lit("utf-8")).isNotNull()
    return let(F.lit(True), lambda _: probe)


Add = Callable[[DataFrame, dict[str, Column]], DataFrame]


def add_sound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for columns that may raise errors: these are null then, and ``_sound`` is unset."""
    sound = F.col("_sound")
    for c in columns.values():
        sound = sound & is_sound(c)
    return df.withColumns({n: F.when(is_sound(c), c) for n, c in columns.items()} | {"_sound": sound})


def words_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def first_of(array: Column) -> Column:
    return F.get(array, F.lit(0))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def most_common(names: Column) -> Column:
    """Most frequent string of an array; ties go to the first seen; null if empty."""
    return let(
        names,
        lambda ns: F.array_max(
            F.transform(
                F.array_distinct(ns),
                lambda n: F.struct(
                    F.size(F.filter(ns, lambda x: x == n)).alias("n"),
                    (-F.array_position(ns, n)).alias("first"),
                    n.alias("name"),
                ),
            )
        )["name"],
    )


def round1(x: Column) -> Column:
    """Round a double of magnitude up to 100 to one decimal, half-even on its exact binary value.

    ``round`` and ``bround`` work on the shortest decimal text of a double, so
    1.05 (stored slightly above 1.05) would round differently.  Scaling by 2**56
    is exact for such doubles, which lets integer arithmetic decide the tie.
    """
    bits = 56
    mask = (1 << bits) - 1
    half = 1 << (bits - 1)

    def scaled(n: Column) -> Column:
        return let_struct(
            lambda s: (
                s["q"]
                + F.when(s["r"] > F.lit(half), F.lit(1))
                .when(s["r"] < F.lit(half), F.lit(0))
                .otherwise(s["q"] % F.lit(2))
            ).cast("double"),
            q=F.shiftright(n, bits) * F.lit(10)
            + F.shiftright(n.bitwiseAND(F.lit(mask)) * F.lit(10), bits),
            r=(n.bitwiseAND(F.lit(mask)) * F.lit(10)).bitwiseAND(F.lit(mask)),
        )

    return let(
        x,
        lambda v: F.signum(v)
        * let((F.abs(v) * F.lit(float(1 << bits))).cast("bigint"), scaled)
        / F.lit(10.0),
    )


def unnest(df: DataFrame, keys: list[str], array: Column | str, position: str | None = None) -> DataFrame:
    """One row per struct of an array, with its position if a name for it is given.

    Uses the outer generator and drops empty rows afterwards: for the plain one
    the optimizer adds a filter on the array's size and pushes it below the
    projections, which would evaluate the whole array expression again.
    """
    out = df.select(*keys, F.posexplode_outer(array).alias("_pos", "_item")).filter(
        F.col("_pos").isNotNull()
    )
    placed = [] if position is None else [F.col("_pos").alias(position)]
    return out.select(*keys, *placed, "_item.*")
