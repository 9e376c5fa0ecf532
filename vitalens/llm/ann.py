"""Nearest vectors by cosine, through few stable projections and a kd-tree.

Vectors are scaled to length 1 and projected on PROJECTIONS Gaussian directions.  For two
vectors at distance d the squared projected distance over d squared is chi-square with
PROJECTIONS degrees of freedom.  A search takes projected neighbours in order of their
distance r and verifies them on the vectors themselves; it stops once a vector nearer
than the k-th best would have shown up with probability CERTAINTY, that is once the
chi-square distribution function of r squared over d squared reaches it.

The upper levels of the kd-tree are fitted on at most SAMPLE rows; every row is filed in
its leaf.  A leaf is worked on in parts of about LEAF_ROWS rows, so a vector that many
rows share is split; a part has the lower levels as a tree of its own, whose buckets are
visited in order.  A query first searches the leaf it lies in, then with the bound it has
the leaves that the stopping test leaves open.

Vectors that are null, empty, zero or hold null or non-finite values take no part.
Vectors of different dimensions are not compared.  Rows of the query's own id are left
out; repeated ids are rows of their own among the candidates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalens.llm.common import saved

PROJECTIONS, CERTAINTY = 8, 0.98  # an even number of projections
SAMPLE, LEAF_ROWS, BUCKET_ROWS, QUERY_ROWS = 20_000, 8192, 128, 8192
SAMPLE_IN_LEAF = 8


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(1, m // 2):
            term = term * half / i
            total = total + term
        return np.where(np.isfinite(half), 1 - np.exp(-half) * total, 1.0)


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, m))


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def split(points: np.ndarray, most: int, least: int) -> list[tuple]:
    """A kd-tree as nodes (axis, value, left, right); a leaf is (-1, number, 0, 0).

    The widest axis is cut at its median until a node has at most `most` points; equal
    points cannot be cut and stay together.
    """
    nodes: list[tuple] = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(())
        if len(rows) > most and len(rows) >= 2 * least:
            part = points[rows]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            value = float(np.median(part[:, axis]))
            low = part[:, axis] < value
            if low.any() and not low.all():
                nodes[at] = (axis, value, grow(rows[low]), grow(rows[~low]))
                return at
        nodes[at] = (-1, leaves, 0, 0)
        leaves += 1
        return at

    grow(np.arange(len(points)))
    return nodes


def leaf_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        axis, value, left, right = nodes[at]
        if axis < 0:
            out[rows] = value
        else:
            low = points[rows, axis] < value
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def regions(nodes: list[tuple], m: int) -> tuple[np.ndarray, np.ndarray]:
    """The corners of the leaves, in order of their numbers."""
    found = {}
    todo = [(0, np.full(m, -np.inf), np.full(m, np.inf))]
    while todo:
        at, low, high = todo.pop()
        axis, value, left, right = nodes[at]
        if axis < 0:
            found[value] = low, high
        else:
            cut_high, cut_low = high.copy(), low.copy()
            cut_high[axis] = cut_low[axis] = value
            todo += [(left, low, cut_high), (right, cut_low, high)]
    return np.stack([found[i][0] for i in range(len(found))]), np.stack([found[i][1] for i in range(len(found))])


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0.0)
    return (gap * gap).sum(axis=2)


class Part:
    """Candidates of one task: their lower tree, and the search of many queries in it."""

    def __init__(self, ids: np.ndarray, rows, m: int):
        self.ids, self.rows, self.m = ids, rows, m
        self.x = unit(rows)
        p = self.x @ directions(self.x.shape[1], m)
        nodes = split(p, BUCKET_ROWS, 1)
        leaf = leaf_of(nodes, p)
        order = np.argsort(leaf, kind="stable")
        cuts = np.searchsorted(leaf[order], np.arange(leaf.max() + 2))
        # Points that no cut parts can exceed a bucket; they are visited in pieces.
        self.buckets = [order[i : min(i + BUCKET_ROWS, b)] for a, b in zip(cuts, cuts[1:]) for i in range(a, b, BUCKET_ROWS)]
        self.low = np.stack([p[b].min(axis=0) for b in self.buckets])
        self.high = np.stack([p[b].max(axis=0) for b in self.buckets])

    def search(self, query_ids: np.ndarray, queries, bounds: np.ndarray, k: int):
        """The k best of this part for each query: arrays of rows in queries, and of rows here."""
        q = unit(queries)
        gaps = box_distances(q @ directions(q.shape[1], self.m), self.low, self.high)
        order = np.argsort(gaps, axis=1, kind="stable")
        best = np.full((len(q), k), -np.inf)
        found = np.full((len(q), k), -1)
        far = np.iinfo(np.int64).max
        active = np.arange(len(q))
        for turn in range(len(self.buckets)):
            near = gaps[active, order[active, turn]]
            kth = np.maximum(best[active, -1], bounds[active])
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(np.isfinite(kth), near / np.maximum(2 - 2 * kth, 0), 0)
            active = active[~(chi_square(np.nan_to_num(ratio, nan=0.0, posinf=np.inf), self.m) >= CERTAINTY)]
            if not len(active):
                break
            turns = order[active, turn]
            for b in np.unique(turns):
                who, here = active[turns == b], self.buckets[b]
                scores = np.round(q[who] @ self.x[here].T, 12)  # equal vectors must tie
                scores[query_ids[who][:, None] == self.ids[here][None]] = -np.inf
                scores = np.concatenate([best[who], scores], axis=1)
                places = np.concatenate([found[who], np.broadcast_to(here, (len(who), len(here)))], axis=1)
                keys = np.where(places < 0, far, self.ids[places])
                top = np.lexsort((keys, -scores), axis=1)[:, :k]
                best[who] = np.take_along_axis(scores, top, axis=1)
                found[who] = np.where(np.isfinite(best[who]), np.take_along_axis(places, top, axis=1), -1)
        return found


def cosine(a, b) -> float:
    """Exactly rounded sums, so that the order of addition does not show."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    dot, aa, bb = (math.fsum(x.tolist()) for x in (a * b, a * a, b * b))
    return dot / (math.sqrt(aa) * math.sqrt(bb))


def usable(column: str):
    return F.expr(f"{column} is not null and size({column}) > 0 and forall({column}, v -> v is not null and not isnan(v) and abs(v) < double('Infinity')) and exists({column}, v -> v <> 0)")


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of df for each id in queries."""

    def clean(x: DataFrame) -> DataFrame:
        return x.select(x[id_col].cast("bigint").alias("id"), x[vector_col].cast("array<double>").alias("x")).where(F.col("id").isNotNull() & usable("x"))

    rows, asked = clean(df), clean(queries).dropDuplicates(["id"])
    dims = [r.d for r in asked.select(F.size("x").alias("d")).distinct().collect()]
    parts = [of_dimension(rows.where(F.size("x") == d), asked.where(F.size("x") == d), d, k) for d in sorted(dims)]
    out = parts[0] if parts else df.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    for p in parts[1:]:
        out = out.union(p)
    return ranked(out, k).select("query_id", "rank", "vec_id", "score")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def of_dimension(rows: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    m, spark = PROJECTIONS, rows.sparkSession
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id", "x"), "id").limit(SAMPLE).select("x").toPandas()["x"] if total else []
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    points = unit(sample) @ directions(dim, m)
    nodes = split(points, max(SAMPLE_IN_LEAF, len(points) * LEAF_ROWS // total), SAMPLE_IN_LEAF)
    low, high = regions(nodes, m)

    @F.pandas_udf("int")
    def leaf(x):
        import pandas as pd

        return pd.Series(leaf_of(nodes, unit(x) @ directions(dim, m)), index=x.index).astype("int32") if len(x) else pd.Series([], dtype="int32")

    @F.pandas_udf("array<int>")
    def open_leaves(x, own, bound):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        kth = bound.fillna(-np.inf).to_numpy()[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(np.isfinite(kth), box_distances(unit(x) @ directions(dim, m), low, high) / np.maximum(2 - 2 * kth, 0), 0)
        go = ~(chi_square(np.nan_to_num(ratio, nan=0.0, posinf=np.inf), m) >= CERTAINTY)
        go[np.arange(len(x)), own.to_numpy()] = False
        return pd.Series([np.flatnonzero(g).astype("int32") for g in go], index=x.index)

    filed = saved(rows.withColumn("leaf", leaf("x")))
    asked = saved(asked.withColumn("leaf", leaf("x")))
    # One row per leaf, of which the sample allows SAMPLE / SAMPLE_IN_LEAF at most.
    sizes = saved(filed.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_ROWS).cast("int").alias("salts")))

    def visit(pairs: DataFrame) -> DataFrame:
        """pairs (id, x, bound, leaf): the best of each leaf for each query sent there."""
        blocks = pairs.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        plan = F.broadcast(saved(sizes.join(blocks, "leaf")))
        side = pairs.join(plan, "leaf").withColumn("block", F.pmod(F.hash("id"), "blocks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        held = filed.join(plan, "leaf").withColumn("salt", F.pmod(F.hash("id", F.lit(1)), "salts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return side.select("leaf", "salt", "block", "id", "x", "bound").groupBy("leaf", "salt", "block").cogroup(held.select("leaf", "salt", "block", "id", "x").groupBy("leaf", "salt", "block")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")

    def search(queries, candidates):
        import pandas as pd

        out = []
        if len(queries) and len(candidates):
            ids, vectors = candidates["id"].to_numpy(), candidates["x"].to_numpy()
            part = Part(ids, vectors, m)
            for start in range(0, len(queries), 512):
                block = queries.iloc[start : start + 512]
                found = part.search(block["id"].to_numpy(), block["x"], block["bound"].fillna(-np.inf).to_numpy(np.float64), k)
                out += [(q, ids[f], cosine(x, vectors[f])) for q, x, hits in zip(block["id"], block["x"], found) for f in hits if f >= 0]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    home = saved(ranked(visit(asked.select("id", "x", F.lit(None).cast("double").alias("bound"), "leaf")), k).drop("rank"))
    bounds = home.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    further = asked.join(bounds, "id", "left").withColumn("leaf", F.explode(open_leaves("x", "leaf", "bound")))
    return home.union(visit(saved(further.select("id", "x", "bound", "leaf"))))
