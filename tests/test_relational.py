import collections
import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vitalens.functions import terms as tm
from vitalens.operators import history as hs
from vitalens.operators import layout as ly
from vitalens.operators import matching as mt
from vitalens.operators import ordered
from vitalens.sources import sinks
from vitalens.streaming import throttle as th

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "word,stem",
    [
        ("mentoring", "mentor"), ("mentored", "mentor"), ("managing", "manag"), ("managed", "manag"),
        ("kubernetes", "kubernetes"), ("queries", "query"), ("planning", "plan"), ("calling", "call"),
        ("boxes", "box"), ("class", "class"), ("code", "cod"), ("k8s", "k8s"), ("uses", "use"), ("ing", "ing"),
    ],
)
def test_stem(spark, word, stem):
    df = spark.createDataFrame([(word,)], "t string")
    assert df.select(tm.stem(F.col("t")).alias("s")).first().s == stem


def _match(spark, cv, posting, **kw):
    docs = spark.createDataFrame([(1, cv)], "doc_id int, text string")
    posts = spark.createDataFrame([(9, posting)], "posting_id int, text string")
    pairs = spark.createDataFrame([(1, 9)], "doc_id int, posting_id int")
    return mt.match_report(docs, posts, pairs).first()


def test_lists_stay_separate_and_aliases_match(spark):
    r = _match(
        spark, "Skills: PostgreSQL, Kafka, k8s clusters",
        "Requirements:\n\u2022 Experience with Postgres, Kafka and Docker\n- kubernetes",
    )
    matched, missing = {t.term: t.variants for t in r.matched}, {t.term for t in r.missing}
    assert {"postgres", "kafka", "kubernetes"} <= set(matched) and "docker" in missing
    assert "k8s" in matched["kubernetes"]
    assert not any(" " in t and "postgres" in t for t in missing)


def test_boilerplate_is_noise(spark):
    r = _match(spark, "anything", "We require strong experience. Must have knowledge of Rust and familiarity with Elixir.")
    terms = {t.term for t in r.matched} | {t.term for t in r.missing}
    assert {"rust", "elixir"} <= terms and not terms & {"require", "experience", "knowledge", "familiarity"}
    only_noise = _match(spark, "anything", "we must have the")
    assert only_noise.has_posting and only_noise.coverage is None
    assert not _match(spark, "anything", "  \n ").has_posting


def test_pairs_cover_single_words(spark):
    posts = spark.createDataFrame([(1, "data platform\ndata platform\nplatform tooling")], "posting_id int, text string")
    rows = {r.key: r["rank"] for r in mt.posting_terms(posts).collect()}
    assert "data platform" in rows and "data" not in rows
    # "platform" (weight 3) ranks above "data platform" (weight 2.8) and stays.
    assert rows["platform"] < rows["data platform"]


def test_term_limit_keeps_the_best(spark):
    words = [f"skill{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    posts = spark.createDataFrame([(1, ", ".join(words))], "posting_id int, text string")
    got = [r.key for r in mt.posting_terms(posts).orderBy("rank").collect()]
    assert len(got) == 28 and got == sorted(got)


def test_no_table_of_postings_goes_through_the_driver(spark, tmp_path):
    """Files of many postings can be small enough for Spark to broadcast what stands for far more in memory."""
    posts = spark.createDataFrame(
        [(1, "data platform\ndata platform\nplatform tooling"), (None, "data platform\ndata platform"), (2, " ")], "posting_id int, text string"
    )
    posts.write.parquet(str(tmp_path / "posts"))
    posts = spark.read.parquet(str(tmp_path / "posts"))
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan_of(mt.posting_terms(posts))
    docs = spark.createDataFrame([(1, "data platform")], "doc_id int, text string")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, None)], "doc_id int, posting_id int")
    matched = mt.match_report(docs, posts, pairs)
    # Only the forms are broadcast, after they were counted.
    assert [x.split("BroadcastHashJoin")[1][:6] for x in plan_of(matched).split("\n") if "BroadcastHashJoin" in x] == [" [form"]
    got = {r.posting_id: (r.has_posting, r.matched_count) for r in matched.collect()}
    assert got == {1: (True, 2), 2: (False, None), None: (False, None)}
    keys = {(r.posting_id, r.key) for r in mt.posting_terms(posts).collect()}
    assert (1, "data") not in keys and (1, "platform") in keys and (None, "data platform") in keys and (None, "data") in keys


def test_salted_join_equals_join(spark):
    many = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("k")
    )
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = sorted(map(tuple, many.join(one, "k", "left").select("id", "k", "v").collect()), key=str)
    salted = ordered.salted_join(many, one, "k", ["id"], hot_rows=100, salts=4)
    assert sorted(map(tuple, salted.select("id", "k", "v").collect()), key=str) == plain


def _reviews(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        owner = "hot" if rnd.random() < 0.4 else f"o{rnd.randrange(5)}"
        rows.append(
            Row(
                review_id=i, doc_id=f"{owner}-{rnd.randrange(3)}", owner_id=owner,
                status=rnd.choice(["complete", "complete", "failed"]), overall=float(rnd.randrange(100)),
                created_at=T0 + dt.timedelta(minutes=rnd.randrange(600)),  # ties happen
            )
        )
    return rows, spark.createDataFrame(rows)


@pytest.mark.parametrize("bucket", ["minute", "hour", "day", "month"])
def test_baselines_match_brute_force(spark, bucket):
    rows, df = _reviews(spark)
    done = [r for r in rows if r.status == "complete"]

    def best(cands):
        return max(cands, key=lambda r: (r.created_at, r.review_id)).review_id if cands else None

    want = {}
    for c in done:
        older = [r for r in done if r.owner_id == c.owner_id and r.created_at < c.created_at]
        want[c.review_id] = best([r for r in older if r.doc_id == c.doc_id]) or best(older)
        same = best([r for r in older if r.doc_id == c.doc_id])
        want[c.review_id] = same if same is not None else best(older)
    got = {r.review_id: r.baseline_id for r in hs.baselines(df, bucket).collect()}
    assert got == want


def test_document_deltas_match_brute_force(spark):
    rows, df = _reviews(spark, seed=5)
    want = {}
    for key in {r.doc_id for r in rows}:
        ordered_rows = sorted((r for r in rows if r.doc_id == key), key=lambda r: (r.created_at, r.review_id))
        for prev, cur in zip([None, *ordered_rows], ordered_rows):
            both = prev is not None and prev.status == cur.status == "complete"
            want[cur.review_id] = round(cur.overall - prev.overall, 1) if both else None
    assert {r.review_id: r.delta for r in hs.document_deltas(df).collect()} == want


def test_history_page_and_bounds(spark):
    rows, df = _reviews(spark)
    docs = df.select("doc_id").distinct().withColumn("filename", F.concat("doc_id", F.lit(".txt")))
    page = hs.history(df, docs, "hot", limit=5, offset=3).collect()
    mine = sorted((r for r in rows if r.owner_id == "hot"), key=lambda r: (r.created_at, r.review_id), reverse=True)
    assert [r.review_id for r in page] == [r.review_id for r in mine[3:8]]
    with pytest.raises(ValueError):
        hs.history(df, docs, "hot", limit=101)


def _throttle_rows(seed):
    rnd = random.Random(seed)
    rows, t = [], {k: 0.0 for k in "abc"}
    for i in range(600):
        k = rnd.choice("aaaabc")
        t[k] += rnd.choice([0, 0.5, 3, 10, 60, 61, 130])
        rows.append((k, i, T0 + dt.timedelta(seconds=t[k])))
    return rows


def _expected(rows, limit, window):
    out, logs = {}, collections.defaultdict(list)
    for k, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        now = (ts - T0).total_seconds()
        log = logs[k] = [x for x in logs[k] if now - x <= window]
        if len(log) >= limit:
            out[i] = max(1, int(window - (now - log[0])) + 1)
        else:
            log.append(now)
            out[i] = None
    return out


@pytest.mark.parametrize("bucket", ["minute", "day"])
def test_throttle_batch(spark, bucket):
    rows = _throttle_rows(1)
    df = spark.createDataFrame(rows, "k string, i bigint, ts timestamp")
    got = {
        r.id: r.retry_after for r in th.throttle(df, "k", "ts", "i", limit=3, window=60, bucket=bucket).collect()
    }
    assert got == _expected(rows, 3, 60)


def _hot_rows(kind, n=3000):
    """A key that never pauses for a minute: at random, in bursts, or to a steady beat; and a few others."""
    rnd = random.Random(8)
    rows, t = [], 0.0
    for i in range(n):
        t += {"random": rnd.expovariate(1 / 7), "bursts": 0 if i % 9 else rnd.uniform(1, 59), "beat": 4.0}[kind]
        rows.append(("hot", i, T0 + dt.timedelta(seconds=min(t, 59.0 + (rows[-1][2] - T0).total_seconds()) if rows else t)))
    return rows + [(f"k{i % 5}", n + i, T0 + dt.timedelta(seconds=11 * i)) for i in range(400)]


@pytest.mark.parametrize("kind,limit", [("random", 3), ("random", 1), ("bursts", 4), ("beat", 2)])
def test_throttle_spreads_a_key_that_never_pauses(spark, kind, limit):
    rows = _hot_rows(kind)
    df = spark.createDataFrame(rows, "k string, i bigint, ts timestamp")
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # or these few rows are read by one task
    spark.conf.set(merge, "false")
    try:
        out = th.throttle(df, "k", "ts", "i", limit=limit, window=60, bucket="hour", piece_windows=20)
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(merge)
    assert {r.id: r.retry_after for r in got} == _expected(rows, limit, 60) and len(got) == len(rows)
    tasks = collections.Counter(r.task for r in got if r.key == "hot")
    assert len(tasks) >= 4 and max(tasks.values()) < 0.7 * sum(tasks.values())


def test_throttle_window_edge(spark):
    rows = [("k", i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 60, 60.000001, 119])]
    df = spark.createDataFrame(rows, "k string, i bigint, ts timestamp")
    got = {r.id: r.admitted for r in th.throttle(df, "k", "ts", "i", limit=1, window=60).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False}  # exactly the window is still inside


def _throttled(spark, tmp_path, batches, lateness):
    """Decisions of a stream that reads one micro-batch after the other."""
    schema = "k string, i bigint, ts timestamp"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (
        th.throttle_stream(stream, "k", "ts", "i", limit=3, window=60, lateness=lateness)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(240)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_throttle_stream_out_of_order_equals_batch(spark, tmp_path):
    rows = _throttle_rows(2)
    shuffled = sorted(rows, key=lambda r: hash((r[1], 7)) % 1009)
    batches = [shuffled[n::5] for n in range(5)]
    end = ("end", -1, max(r[2] for r in rows) + dt.timedelta(days=3))
    got = {r.id: r.retry_after for r in _throttled(spark, tmp_path, [*batches, [end]], "1 day")}
    got.pop(-1, None)  # the closing request itself still waits for the watermark
    assert got == _expected(rows, 3, 60)


class _State:
    """State of one key in memory, with the waiting requests that were read."""

    def __init__(self):
        self.value, self.map, self.timers, self.read = None, {}, set(), 0

    def handle(self):
        outer = self

        class Value:
            def __init__(self):
                self.v = None

            exists = lambda self: bool(self.v)
            get = lambda self: self.v

            def update(self, v):
                self.v = v

            put = update

            def clear(self):
                self.v = None

        class Map:
            def getValue(self, k):
                outer.read += len(outer.map[k][0])
                return outer.map[k]

            def updateValue(self, k, v):
                outer.map[k] = v

            def removeKey(self, k):
                del outer.map[k]

        class Handle:
            getListState = getValueState = lambda self, *_: Value()
            getMapState = lambda self, *_: Map()
            listTimers = lambda self: list(outer.timers)
            registerTimer = lambda self, t: outer.timers.add(t)
            deleteTimer = lambda self, t: outer.timers.discard(t)

        return Handle()


def test_throttle_stream_reads_due_requests_only():
    """Ten hours of one key, a request every 10 s, an hour of lateness: each request is read about once."""
    import pandas as pd

    class At:
        def __init__(self, ms):
            self.ms = ms

        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.ms

    state, got, n = _State(), {}, 3600
    log = th.SlidingLog(3, 60)
    log.init(state.handle())
    take = lambda frames: got.update({int(r.id): r.retry_after for f in frames for r in f.itertuples()})
    micros = [i * 10_000_000 for i in range(n)]
    for start in range(0, n, 90):  # batches of a quarter of an hour
        batch = list(range(start, min(n, start + 90)))
        random.Random(start).shuffle(batch)
        mark = max(0, (micros[start] - 3_600_000_000) // 1000)
        take(log.handleInputRows(("k",), iter([pd.DataFrame({"micros": [micros[i] for i in batch], "id": batch})]), At(mark)))
        while state.timers and min(state.timers) <= mark:
            fired = min(state.timers)
            state.timers.discard(fired)
            take(log.handleExpiredTimer(("k",), At(mark), At(fired)))
    mark = micros[-1] // 1000 + 10**6
    while state.timers and min(state.timers) <= mark:
        fired = min(state.timers)
        state.timers.discard(fired)
        take(log.handleExpiredTimer(("k",), At(mark), At(fired)))
    rows = [("k", i, T0 + dt.timedelta(microseconds=m)) for i, m in enumerate(micros)]
    assert {i: None if pd.isna(w) else int(w) for i, w in got.items()} == _expected(rows, 3, 60)
    assert state.read < 1.2 * n and not state.map and not state.timers


def test_throttle_stream_names_late_requests(spark, tmp_path):
    t = dt.datetime(2026, 1, 1, 12)
    batches = [
        [("a", 0, t), ("b", 1, t + dt.timedelta(hours=1))],
        [("a", 2, t + dt.timedelta(minutes=1)), ("a", 3, t + dt.timedelta(hours=2))],
        [("b", 4, t + dt.timedelta(hours=9))],
    ]
    got = {r.id: (r.admitted, r.reason) for r in _throttled(spark, tmp_path, batches, "1 minute")}
    assert got == {0: (True, None), 1: (True, None), 2: (None, "late"), 3: (True, None)}


def test_stored_reviews_feed_history_and_erasure(spark, tmp_path):
    review = "struct<rule_id:string,category:string,severity:string,penalty:double,evidence:array<string>,section:string>"
    rows = [(f"d{i}", f"o{i % 2}", 70.0 + i, [("contact.x", "contact", "warning", 5.0, ["q"], None)], [("contact", 95.0)], [("contact.x",)]) for i in range(4)]
    schema = f"doc_id string, owner_id string, overall double, findings array<{review}>, category_scores array<struct<category:string,score:double>>, priorities array<struct<rule_id:string>>"
    reviews = spark.createDataFrame(rows, schema)
    target, day = str(tmp_path / "store"), dt.datetime(2026, 1, 1).date()
    for run in ("one", "two", "two"):  # the second attempt of a run replaces the first
        sinks.write_reviews(reviews, target, day, run, dt.datetime(2026, 1, 1, 1 if run == "one" else 2))
    names = ("reviews", "findings", "category_scores", "priorities")
    stored = {n: spark.read.parquet(f"{target}/{n}") for n in names}
    assert {n: df.count() for n, df in stored.items()} == dict.fromkeys(names, 8)
    assert hs.completed(stored["reviews"]).select("review_id").distinct().count() == 8
    assert {r.owner_id for r in hs.owned(stored["reviews"], "o1").collect()} == {"o1"}
    erased = spark.createDataFrame([("owner", "o1"), ("document", "d0")], "kind string, id string")
    left = hs.erase(stored, erased)
    assert {n: {r.doc_id for r in df.collect()} for n, df in left.items()} == dict.fromkeys(names, {"d2"})


def test_table_rows_drop_repeats(spark):
    cells = [(1, 0, 0, i, c) for i, c in enumerate(["a", "a", "", "a", "b"])] + [(1, 0, 1, 0, "")]
    df = spark.createDataFrame(cells, "doc_id int, table_no int, row_no int, col_no int, cell string")
    assert [r.line for r in ly.table_rows(df).collect()] == ["a | b"]


def test_two_columns_need_forty_words(spark):
    def page(doc, n_left, n_right, n_mid):
        boxes = [(50.0, 90.0)] * n_left + [(400.0, 450.0)] * n_right + [(290.0, 320.0)] * n_mid
        return [(doc, 1, a, b, 612.0) for a, b in boxes]

    rows = page(1, 20, 20, 2) + page(2, 15, 15, 2) + page(3, 20, 20, 10) + page(4, 40, 5, 0)
    df = spark.createDataFrame(rows, "doc_id int, page int, x0 double, x1 double, page_width double")
    got = {r.doc_id: r.multi_column_pages for r in ly.multi_column_counts(df).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0}
