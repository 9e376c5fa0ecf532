"""Source mixing, periodic runs and importance resampling against brute force, and on edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ROWS, prose
from tests.oracle_check import connect, rows as comparable
from vitalens.llm import common, importance, mixing, queries, runs

CLASH = "row source_size target taken key size weight place place_ number rank score text_key n_words periodic _part _tie _place prefix tie need copy h"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{k % 4}" if k % 5 else None) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit("x") for c in CLASH.split()})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# --- helpers -------------------------------------------------------------------------------------


def test_numbers_follow_the_order_and_tell_ties_apart(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 900).alias("v")).repartition(13)
    got = [(r.number, r.v) for r in common.numbered(df, [F.col("v").desc()]).collect()]
    assert [v for _, v in sorted(got)] == sorted((v for _, v in got), reverse=True)
    assert sorted(n for n, _ in got) == list(range(1, 5001))
    assert common.numbered(df.limit(0), ["v"]).count() == 0


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    column = ["a" * n for n in (3, 4, 50, 0, 1, 9, 9)] + [None, "é"]
    parts = list(common.by_bytes([pa.RecordBatch.from_arrays([pa.array(column)], names=["t"])], 0, 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == column
    assert [p.num_rows for p in parts] == [2, 1, 3, 2, 1]


# --- mixing --------------------------------------------------------------------------------------


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares_by_rounds(sizes, weights, budget, epochs):
    """Targets as exact fractions: clamp what is above its cap, share the rest again."""
    targets, open_ = {}, dict(weights)
    while open_:
        left = budget - sum(targets.values())
        over = {s for s, w in open_.items() if Fraction(left * w, sum(open_.values())) > epochs * sizes[s]}
        if not over:
            return targets | {s: Fraction(left * w, sum(open_.values())) for s, w in open_.items()}
        for s in over:
            targets[s] = Fraction(epochs * sizes[s])
            del open_[s]
    return targets


def mixed_by_force(rows, weights=(5, 2, 1), epochs=3, share=1):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = shares_by_rounds(sizes, {s: weights[k % len(weights)] for k, s in enumerate(order)}, math.floor(sum(sizes.values()) * share), epochs)
    out = []
    for s in order:
        own = [(i, t) for i, t, x in rows if x == s]
        keyed = defaultdict(int)
        key = {d: int(hashlib.md5(f"17:{'' if d[0] is None else d[0]}:{hashlib.md5((d[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:12], 16) for d in own}
        for d in own:
            keyed[key[d]] += size(d[1])
        words = math.floor(targets[s] + Fraction(1, 2))
        passes, need = divmod(words, sizes[s]) if sizes[s] else (0, 0)
        for d in own:
            before, n = sum(v for k, v in keyed.items() if k < key[d]), size(d[1])
            tie = keyed[key[d]]
            extra = min(n, max(0, need - before) * n // tie) if tie else 0
            out.append((d[0], n, sizes[s], round(float(targets[s]), 6), passes * n + extra))
    return sorted(map(str, out))


def got_mixed(df, **options):
    return sorted(str((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)) for r in mixing.mixed(df, **options).collect())


def test_mix_by_force(docs, empty):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert got_mixed(docs) == mixed_by_force(rows) == got_mixed(docs.repartition(5))
    assert got_mixed(docs, share=0.3, weights=(1, 9)) == mixed_by_force(rows, (1, 9), share=0.3)
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(empty).count() == 0
    assert {(r.size, r.target, r.taken) for r in mixing.mixed(docs.where("doc_id in (2, 3, 4)")).collect()} == {(0, 0.0, 0)}


def test_excess_is_shared_again_until_no_target_is_above(spark):
    # Clamping the small sources of large weight lifts the next ones above their caps.
    r, rows = random.Random(4), []
    for s, n in (("a", 2), ("b", 3), ("c", 4), ("d", 20), ("e", 400), ("f", 60), ("g", 1), ("Z", 9), (None, 30), ("", 5)):
        rows += [(len(rows) + k, " ".join(["w"] * r.randint(1, 40)), s) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert got_mixed(df) == mixed_by_force(rows)
    got = mixing.mixed(df).collect()
    by_source = defaultdict(lambda: [0, 0.0, 0])
    for x in got:
        by_source[x.source] = [by_source[x.source][0] + x.taken, x.target, x.source_size]
        assert x.taken <= 3 * x.size
    assert all(abs(taken - target) <= 0.5 and target <= 3 * n for taken, target, n in by_source.values())
    assert abs(sum(t for _, t, _ in by_source.values()) - sum(n for *_, n in by_source.values())) < 1e-6
    assert any(t == 3 * n for _, t, n in by_source.values())


def test_mixture_holds_the_words_it_names(spark, docs):
    taken = Counter()
    for r in mixing.mixture(docs, share=0.7).collect():
        taken[r.row.doc_id] += size(r.text)
        assert r.row.h == "x" and (r.row.text or "").split()[: size(r.text)] == r.text.split()
    want = Counter()
    for r in mixing.mixed(docs, share=0.7).collect():
        want[r.doc_id] += r.taken
    assert +taken == +want


def test_more_than_all_sources_allow(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.mixed(df, share=9.0).collect()) == [(1, 6.0, 6), (2, 3.0, 3)]


def test_the_mix_stays_in_the_jvm(spark, docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# --- runs ----------------------------------------------------------------------------------------


def runs_by_force(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(w[i : j + q - p] == w[i + p : j + q] for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_by_force():
    r, total = random.Random(1), 0
    for _ in range(1500):
        letters, w = [f"w{i}" for i in range(r.choice([1, 2, 3, 8, 40]))], []
        for _ in range(r.randint(0, 6)):
            cycle = [r.choice(letters) for _ in range(r.randint(1, 5))]
            w += (cycle * 10)[: r.randint(1, 30)] if r.random() < 0.5 else [r.choice(letters) for _ in range(r.randint(0, 12))]
        got = runs.runs_of(runs.numbered_words(w), np.zeros(len(w), np.int64))
        assert got == runs_by_force(w), w
        total += len(got)
    assert total > 1000


def test_texts_of_a_batch_are_apart():
    w = ["a"] * 5 + ["a"] * 5 + ["a"] * 7
    owner = np.repeat([0, 1, 2], [5, 5, 7])
    assert runs.runs_of(runs.numbered_words(w), owner) == [(10, 7, 1)]


def test_comparisons_in_parts_change_nothing(monkeypatch):
    r = random.Random(3)
    w = [r.choice("ab") for _ in range(400)] + ["c", "d", "e"] * 60 + ["a"] * 90
    want = runs.runs_of(runs.numbered_words(w), np.zeros(len(w), np.int64))
    monkeypatch.setattr(runs, "PAIRS", 50)
    assert runs.runs_of(runs.numbered_words(w), np.zeros(len(w), np.int64)) == want == runs_by_force(w)


def test_agreement_is_verified(monkeypatch):
    """Were all hashes equal, every stretch would be compared word by word, with the same runs."""
    r = random.Random(5)
    w = [r.choice("abc") for _ in range(120)] + ["x", "y"] * 9 + [r.choice("abc") for _ in range(50)]
    monkeypatch.setattr(runs, "mixed", lambda h: h * np.uint64(0))
    got = runs.runs_of(runs.numbered_words(w), np.zeros(len(w), np.int64))
    assert got == runs_by_force(w)


def test_rows_with_runs(spark, docs, empty):
    extra = [(50, "x y " * 40 + "end", "s"), (51, "é b é b é b é b é b é b", "s"), (52, "r " * 30_000, "s"), (52, "r " * 30_000, "s")]
    df = docs.select("doc_id", "text", "source").union(spark.createDataFrame(extra, "doc_id bigint, text string, source string")).withColumn("periodic", F.lit(1))
    got = runs.periodic_runs(df).collect()
    assert len(got) == len(ROWS) + len(extra)
    for r in got:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", r.row.text or "") if x]
        want = runs_by_force(w) if len(w) < 5000 else [(0, len(w), 1)] if len(set(w)) == 1 else []
        assert [tuple(x) for x in r.periodic.runs] == want and r.periodic.n_words == len(w) and r.row.periodic == 1
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.periodic.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert runs.periodic_runs(empty).count() == 0


def test_repeated_tails_and_digests(spark, tmp_path):
    rows = [(i, prose(i, 30 + 9 * (i % 7))) for i in range(300)] + [(None, "a " * 9), (7000, None), (7001, ""), (7002, " "), (40, "one")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = (t or "").split()
        n, h = len(w), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        found = runs_by_force(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        digests = ["".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(x for k, x in enumerate(w) if k not in gone)]
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in digests)))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert got.columns == names
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert sum(w[1] > 0 for w in want) > 10


# --- importance ------------------------------------------------------------------------------------


def features(text, most=1):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return w, [b" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def drawn_by_force(rows, target, most=1, buckets=10_000, least=20, percent=10):
    s, t = (Counter(zlib.crc32(f) % buckets for x in texts for f in features(x, most)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        w, f = features(text, most)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in (zlib.crc32(x) % buckets for x in f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((o for o in out if o[5] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1]))
    for place, o in enumerate(fit[: percent * len(fit) // 100], 1):
        o[4] = place
    return sorted(str(tuple(o[:5])) for o in out)


@pytest.mark.parametrize("most,buckets,least,percent", [(1, 10_000, 20, 10), (2, 50, 0, 60), (3, 977, 2, 100)])
def test_importance_by_force(spark, docs, most, buckets, least, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, prose(i, 25)) for i in range(40)] + [(200, "a--B c" * 9), (201, "\x00é É漢 字 ZZ zz" * 8)]
    target = [prose(3, 50), None, "", prose(5, 10), "漢 字"]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in CLASH.split()}).repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(df, goal, percent=percent, min_words=least, max_n=most, buckets=buckets).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == drawn_by_force(rows, target, most, buckets, least, percent)


@pytest.mark.parametrize("kind", ["string", "large_string"])
def test_words_of_slices(kind):
    import pyarrow as pa

    texts = [f"{i} é{i} Ñandú, ÷x" if i % 7 else None for i in range(200)]
    column = pa.array(texts, pa.string()).cast(kind)
    for start, n in ((0, 200), (150, 50), (13, 7), (199, 1), (5, 0)):
        for part in (column.slice(start, n), pa.array(texts, pa.string()).slice(start, n).cast(kind)):
            sizes, words = importance.words_of(part)
            want = [features(t)[0] for t in texts[start : start + n]]
            assert sizes.tolist() == [len(w) for w in want]
            assert words.cast(pa.binary()).to_pylist() == [x for w in want for x in w]


def test_importance_without_rows(spark, docs, empty):
    goal = spark.createDataFrame([("two words",)], "text string")
    assert importance.resampled(empty, goal).count() == 0
    got = importance.resampled(docs, goal.limit(0)).collect()
    assert len(got) == len(ROWS) and sum(r["rank"] is not None for r in got) == sum(r.n_words >= 20 for r in got) // 10


def test_draws_follow_the_weights(spark):
    """Over many seeds, documents are drawn in proportion to exp(weight / 1000)."""
    rows = [(i, "good " * (i % 3) + "raw raw") for i in range(3)]
    df, goal = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("good raw raw",)], "text string")
    gains = importance.gains_of(importance.counts_of(goal, "text", 1, 50), importance.counts_of(df, "text", 1, 50))
    weight = {r.doc_id: r.weight / 1000 for r in importance.weighted(df, gains, "doc_id", "text", 1).collect()}
    first, seeds = Counter(), 4000
    for seed in range(seeds):
        score = {}
        for i in weight:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score[i] = weight[i] - math.log(-math.log((h + 0.5) / 4294967296))
        first[max(score, key=score.get)] += 1
    total = sum(map(math.exp, weight.values()))
    assert all(abs(first[i] / seeds - math.exp(w) / total) < 0.03 for i, w in weight.items())


# --- SQL -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_source_mix", "op12_periodic_runs", "op13_importance_resampling"])
def test_queries_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    got, want = queries.QUERIES[name](spark, d), connect(d).sql(queries.SQL[name])
    assert comparable(got.columns, got.collect()) == comparable(want.columns, want.fetchall())
