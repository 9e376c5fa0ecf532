"""Near-duplicate documents by a join of MinHash signatures, inverted by coordinate.

A document's words are the runs of characters other than white space, with A-Z in
lower case; its set holds the distinct runs of SHINGLE words, or all words as one
run if there are fewer.  Documents are linked if their sets have a Jaccard similarity
of at least PERCENT / 100, and the smallest doc_id that links reach is their component.

1. Documents of one set form a class, and one text stands for it.
2. The signature has COORDINATES minima.  Documents are posted under each pair of
   coordinate and value.  Two texts are candidates if at least `matches` pairs agree, the
   largest number for which a pair at the limit is missed in at most MISSED of all cases:
   16 at 0.85 (6 in ten million), 13 at 0.80 (2 in ten million).
3. Prefix: with pairs ordered by how many classes carry them, candidates share one of
   their COORDINATES - matches + 1 rarest pairs, so only those are posted; pairs of one
   class alone are skipped, and so are classes that cannot reach that number any more.
4. In each posted list the class whose pairs are the most common is the centre; the rest
   are compared with it.  Lists whose classes are then connected are done.  In the others
   classes of different components are compared.  So a group of near copies costs one
   comparison per copy, and no pair that could join two components is left out.
   Of the shingles that fall in one of BUCKETS by their hash, two classes cannot share more
   than the smaller number that either of them shares with any class left; the sum over
   the buckets rules out nearly all pairs of a group of distant copies.
5. Each comparison counts agreeing pairs first and is confirmed on the full sets.

Null and empty texts, and texts of white space, have an empty set and no links.  A null
doc_id has no links, no component and is kept.  Every row of the input gives a row; rows
that share a doc_id with different texts each get the component of their own set.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalens.llm.common import WordHashes, arrow_map, mixed, rolling, saved, slices, sorted_join, texts
from vitalens.llm.components import components

SHINGLE, PERCENT = 5, 85
COORDINATES, MISSED = 32, 1e-6
BUCKETS = 64


class Shingles:
    """Sorted distinct hashes of the shingles of a text."""

    def __init__(self, size: int):
        self.size, self.hashes = size, WordHashes()

    def of(self, text: bytes) -> np.ndarray:
        h = self.hashes.of(text.lower().split())
        return np.unique(rolling(h, min(self.size, len(h)))) if len(h) else h


def seeds(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    s = mixed(np.arange(1, 2 * coordinates + 1, dtype=np.uint64))
    return s[:coordinates] | np.uint64(1), s[coordinates:]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of the shingles under each of the linear hashes."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        low = np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
    return (mixed(low) >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, minima): the set's digest, null if empty, and its signature."""

    def work(batches):
        sets, (a, b) = Shingles(size), seeds(COORDINATES)
        for batch in slices(batches):
            counts, keys, minima = [], [], []
            for text in texts(batch.column(2)):
                s = sets.of(text)
                counts.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                minima.append(signature(s, a, b).view(np.int32).tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.list_(pa.int32()))],
                names=["doc_id", "text_key", "n_shingles", "set_key", "minima"],
            )

    return arrow_map(
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"),
        work,
        "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, minima array<int>",
    )


def matches_of(percent: int) -> int:
    """The most agreeing coordinates to ask for that miss a pair of that similarity in at most MISSED of all cases."""
    p, missed = percent / 100, 0.0
    for m in range(COORDINATES):
        missed += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)  # m agree, fewer than m + 1
        if missed > MISSED:
            return max(1, m)
    return COORDINATES


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """(token, class, weight): the rarest pairs of each class that another class may share."""
    pairs = classes.select("class", F.posexplode("minima").alias("at", "value")).select(
        "class", (F.col("at").cast("bigint") * F.lit(1 << 32) + F.col("value")).alias("token")
    )
    carried = pairs.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    held = pairs.join(sorted_join(carried), "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    room = F.greatest(F.lit(0), F.size("tokens") - (matches - 1))  # pairs of one class alone come first in the prefix
    return (
        held.where(F.size("tokens") >= matches)
        .withColumn("weight", F.aggregate("tokens", F.lit(0).cast("bigint"), lambda s, t: s + t["n"]))
        .select("class", "weight", F.explode(F.slice("tokens", 1, room)).alias("t"))
        .select(F.col("t.token").alias("token"), "class", "weight")
    )


def alike(percent: int):
    """Whether size and signature leave a pair of classes a chance: n_a, minima_a against n_b, minima_b."""
    agreeing = F.size(F.filter(F.zip_with("minima_a", "minima_b", lambda x, y: x == y), lambda same: same))
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (agreeing >= matches_of(percent))


def sided(df: DataFrame, side: str, *names: str) -> DataFrame:
    return df.select(*[F.col(n).alias(n if n == "token" else side if n == "class" else f"{n}_{side}") for n in names])


def confirmed(pairs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    whole = pairs.join(sorted_join(sided(reps, "b", "class", "text")), "b").join(sorted_join(sided(reps, "a", "class", "text")), "a").select("a", "b", "text_a", "text_b")

    def work(batches):
        sets, before, own = Shingles(size), None, None
        for batch in slices(batches):
            keep = []
            for a, text_a, text_b in zip(batch.column(0).to_pylist(), texts(batch.column(2)), texts(batch.column(3))):
                if a != before:  # pairs of one centre mostly follow each other
                    before, own = a, sets.of(text_a)
                other = sets.of(text_b)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return saved(arrow_map(whole, work, "a bigint, b bigint"))


def shared(reps: DataFrame, size: int) -> DataFrame:
    """(class, held): for each bucket, how many shingles of a class some other class of reps has as well."""

    def work(batches):
        sets = Shingles(size)
        for batch in slices(batches):
            found = [sets.of(t) for t in texts(batch.column(1))]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["class", "shingle"])

    def count(batches):
        sets = Shingles(size)
        for batch in slices(batches):
            held = [np.bincount((sets.of(t) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).tolist() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64()))], names=["class", "every"])

    slim = reps.select("class", "text")
    single = arrow_map(slim, work, "class bigint, shingle bigint").groupBy("shingle").agg(F.count("*").alias("holders"), F.min("class").alias("class")).where("holders = 1")
    # Hashes are unsigned in the tasks and signed here; their low bits agree.
    bucket = F.col("shingle").bitwiseAND(BUCKETS - 1)
    single = single.groupBy("class").agg(F.array(*[F.count(F.when(bucket == i, 1)) for i in range(BUCKETS)]).alias("alone"))
    both = arrow_map(slim, count, "class bigint, every array<bigint>").join(sorted_join(single), "class", "left")
    return both.select("class", F.when(F.col("alone").isNull(), F.col("every")).otherwise(F.zip_with("every", "alone", lambda n, k: n - k)).alias("held"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, kept."""
    docs = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text"))
    signed = saved(signatures(docs, size))
    known = signed.where("set_key is not null and doc_id is not null")
    # One document stands for each distinct set; the smallest id names the class.
    classes = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "minima")).alias("r"))
    classes = saved(classes.select("set_key", F.col("r.doc_id").alias("class"), F.col("r.text_key").alias("text_key"), F.col("r.n_shingles").alias("n"), F.col("r.minima").alias("minima")))
    posted = saved(postings(classes, matches_of(percent)))
    slim = classes.drop("set_key").join(sorted_join(posted.select("class").distinct()), "class", "left_semi")
    texts_of = docs.select(F.col("doc_id").alias("class"), F.xxhash64("text").alias("text_key"), "text")
    reps = saved(texts_of.join(sorted_join(slim.select("class", "text_key", "n")), ["class", "text_key"]).dropDuplicates(["class", "text_key"]).select("class", "n", "text"))

    centres = posted.groupBy("token").agg(F.max(F.struct("weight", (-F.col("class")).alias("last"))).alias("top")).select("token", (-F.col("top.last")).alias("a"))
    stars = posted.join(sorted_join(centres), "token").where("class != a").select("a", F.col("class").alias("b")).distinct()
    near = stars.join(sorted_join(sided(slim, "a", "class", "n", "minima")), "a").join(sorted_join(sided(slim, "b", "class", "n", "minima")), "b").where(alike(percent))
    near = saved(near.select("a", "b"))
    links = confirmed(near, reps, size, percent)
    joined = components(links).withColumnRenamed("node", "class")

    # Lists in which more than one component is left, and the pairs across components in them.
    placed = posted.join(sorted_join(joined), "class", "left").select("token", "class", F.coalesce("component", "class").alias("part"))
    open_lists = placed.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("token")
    rest = saved(placed.join(sorted_join(open_lists), "token"))
    common = saved(shared(reps.join(sorted_join(rest.select("class").distinct()), "class", "left_semi"), size))
    total = lambda counts: F.aggregate(counts, F.lit(0).cast("bigint"), lambda n, x: n + x)
    chosen = slim.join(sorted_join(common.withColumn("s", total("held"))), "class").where(100 * F.col("s") >= percent * F.col("n"))
    rest = saved(rest.join(sorted_join(chosen), "class"))
    columns = ("token", "class", "part", "n", "s", "held", "minima")
    enough = lambda both: 100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)
    # The cheap bound goes first; the arrays are compared only where it leaves a chance.
    chance = F.when(enough(F.least("s_a", "s_b")), alike(percent) & enough(total(F.zip_with("held_a", "held_b", lambda x, y: F.least(x, y)))))
    across = sided(rest, "a", *columns).join(sorted_join(sided(rest, "b", *columns)), "token").where((F.col("part_a") < F.col("part_b")) & chance)
    tested = near.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    across = across.select("a", "b", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct().join(sorted_join(tested), ["p", "q"], "left_anti")
    more = confirmed(across.select("a", "b"), reps, size, percent)
    found = components(links.union(more)) if not more.isEmpty() else joined.withColumnRenamed("class", "node")

    owned = known.join(sorted_join(classes.select("set_key", "class")), "set_key").select("doc_id", "text_key", "class").distinct()
    owned = owned.join(sorted_join(found.withColumnRenamed("node", "class")), "class", "left").select("doc_id", "text_key", F.coalesce("component", "class").alias("component_id"))
    out = signed.select("doc_id", "text_key", "n_shingles").join(sorted_join(owned), ["doc_id", "text_key"], "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
