"""Comparison by cards, tables stored by owner, erasure of stored tables, cubes, repeated uploads."""

import datetime as dt
import os
import random

import pytest
from conftest import STRONG_CV, TODAY, WEAK_CV
from pyspark.sql import functions as F

from vitalens.operators import comparison as cm
from vitalens.operators import history as hs
from vitalens.operators import rules as ru
from vitalens.plans import corpus
from vitalens.sources import sinks, stored
from vitalens.streaming import uploads as up

T0 = dt.datetime(2026, 1, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- comparison ------------------------------------------------------------------------------


def _reviews(spark, n=60, seed=3):
    r, ids = random.Random(seed), [f"rule.{i}" for i in range(150)]  # more rules than one mask word holds
    severities = ("critical", "warning", "suggestion", "positive")
    reviews = [(i, round(r.uniform(0, 100), 3)) for i in range(n)]
    findings = [(i, rule, r.choice(severities)) for i in range(n) for rule in r.sample(ids, r.randint(0, 40))]
    scores = [(i, c, round(r.uniform(0, 100), 2), r.random() < 0.8) for i in range(n) for c in "abc"]
    pairs = [(i, r.randrange(n)) for i in range(n)]
    frames = (
        spark.createDataFrame(reviews, "review_id int, overall double"),
        spark.createDataFrame(findings, "review_id int, rule_id string, severity string"),
        spark.createDataFrame(scores, "review_id int, category string, score double, applicable boolean"),
        spark.createDataFrame(pairs, "review_id int, baseline_id int"),
    )
    return frames, (dict(reviews), findings, scores, pairs), cm.RuleBits(tuple(ids))


def test_comparison_by_force(spark):
    (reviews, findings, scores, pairs), (overall, found, scored, asked), bits = _reviews(spark)
    got = {(r.review_id, r.baseline_id): r for r in cm.compare(pairs, cm.review_cards(reviews, findings, scores, bits), bits).collect()}
    open_ = {i: {rule: s for j, rule, s in found if j == i and s != "positive"} for i in overall}
    used = {i: {c: x for j, c, x, ok in scored if j == i and ok} for i in overall}
    assert set(got) == set(asked)
    for (a, b), r in got.items():
        now, old = open_[a], open_[b]
        assert [tuple(x) for x in r.resolved] == sorted((k, s) for k, s in old.items() if k not in now)
        assert [tuple(x) for x in r.introduced] == sorted((k, s) for k, s in now.items() if k not in old)
        assert [tuple(x) for x in r.still_open] == sorted((k, s) for k, s in now.items() if k in old)
        assert abs(r.overall_delta - (overall[a] - overall[b])) <= 0.0501
        assert [(c.category) for c in r.categories] == sorted(set(used[a]) & set(used[b]))
        assert all(abs(c.delta - (used[a][c.category] - used[b][c.category])) <= 0.0501 for c in r.categories)


def test_comparison_exchanges_and_views(spark, tmp_path):
    frames, _, bits = _reviews(spark)
    reviews, findings, scores, pairs = (store(spark, df, tmp_path, n) for n, df in enumerate(frames))
    compared = cm.compare(pairs, cm.review_cards(reviews, findings, scores, bits), bits)
    for df in (compared, cm.finding_diff(compared), cm.category_deltas(compared)):
        plan = plan_of(df)
        assert plan.count("Exchange hashpartitioning") <= 4 and "Window" not in plan and "Python" not in plan
    n = compared.select(F.sum(F.size("resolved") + F.size("introduced") + F.size("still_open"))).first()[0]
    assert cm.finding_diff(compared).count() == n


def store(spark, df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_a_rule_without_a_bit_is_an_error(spark):
    (reviews, findings, scores, _), _, _ = _reviews(spark, 5)
    with pytest.raises(Exception, match="rule without a bit"):
        cm.review_cards(reviews, findings, scores, cm.RuleBits(("rule.1",))).collect()


def test_fresh_reviews_carry_the_same_cards(spark, docs_of):
    bits = cm.RuleBits.of(ru.document_catalogue(), ru.keyword_catalogue())
    scored = corpus.score_corpus(docs_of(STRONG_CV, WEAK_CV), TODAY).withColumnRenamed("doc_id", "review_id")
    fresh = scored.select("review_id", "overall", *[c.alias(n) for n, c in cm.card_columns(bits).items()])
    long = cm.review_cards(scored, corpus.findings_table(scored, "review_id"), corpus.category_table(scored, "review_id"), bits)
    assert {r.review_id: (r.overall, r.scores, r.open) for r in fresh.collect()} == {r.review_id: (r.overall, r.scores, r.open) for r in long.collect()}


# --- tables stored by owner ------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    n = 400
    reviews = spark.range(n).select(
        F.col("id").alias("review_id"),
        F.concat(F.lit("o"), F.col("id") % 7).alias("owner_id"),
        F.concat(F.lit("d"), F.col("id") % 7, F.lit("-"), F.col("id") % 3).alias("doc_id"),
        F.when(F.col("id") % 5 == 0, "failed").otherwise("complete").alias("status"),
        (F.col("id") % 83).cast("double").alias("overall"),
        F.timestamp_seconds(F.col("id") * 1000).alias("created_at"),
        F.when(F.col("id") % 2 == 0, "").otherwise("analyst").alias("target_role"),
        F.concat(F.lit("2026-01-0"), F.col("id") % 2 + 1).cast("date").alias("review_date"),
    )
    docs = reviews.select("owner_id", "doc_id").distinct().withColumn("filename", F.lit("f"))
    owners = reviews.select("owner_id").distinct().withColumn("target_role", F.concat(F.lit("role of "), "owner_id"))
    out = {
        "reviews": stored.write_table(reviews, "t_reviews", f"{folder}/reviews", ("review_date",), buckets=8),
        "docs": stored.write_table(docs, "t_docs", f"{folder}/docs", buckets=8),
        "owners": stored.write_table(owners, "t_owners", f"{folder}/owners", buckets=8),
        "plain": (reviews, docs, owners),
        "folder": folder,
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield out
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for t in ("t_reviews", "t_docs", "t_owners"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_one_owner_reads_one_bucket(tables):
    df = hs.owned(tables["reviews"], "o3")
    rows = df.collect()
    assert sorted(r.review_id for r in rows) == [i for i in range(400) if i % 7 == 3]
    grouped = df.groupBy("owner_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in grouped and "SelectedBucketsCount: 1 out of 8" in grouped


def test_owner_joins_and_groupings_stay_in_place(tables):
    reviews, docs, owners = tables["plain"]
    cases = (
        (hs.with_target_role(tables["reviews"], tables["owners"]), hs.with_target_role(reviews, owners), "review_id"),
        (hs.decorate(tables["docs"], tables["reviews"]), hs.decorate(docs, reviews), "doc_id"),
    )
    for got, want, key in cases:
        assert "Exchange" not in plan_of(got)
        columns = sorted(want.columns)
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_files_of_an_earlier_session_are_opened_and_partitions_replaced(spark, tables):
    path = f"{tables['folder']}/reviews"
    schema = stored.schema_of(tables["plain"][0], ("review_date",))
    again = stored.open_table(spark, "t_again", path, schema, ("review_date",), buckets=8)
    try:
        assert again.count() == 400
        day = tables["plain"][0].filter("review_date = '2026-01-01' and owner_id = 'o0'")
        stored.write_table(day, "t_again", path, ("review_date",), buckets=8)
        assert spark.table("t_again").count() == 200 + day.count()
    finally:
        spark.sql("DROP TABLE t_again")
        stored.write_table(tables["plain"][0], "t_reviews", path, ("review_date",), buckets=8)


# --- erasure ---------------------------------------------------------------------------------


def _times(folder):
    return {p: os.path.getmtime(p) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet") for p in [os.path.join(d, n)]}


def test_erasure_rewrites_only_what_holds_erased_rows(spark, docs_of, tmp_path):
    target = str(tmp_path / "store")
    scored = corpus.score_corpus(docs_of(STRONG_CV, WEAK_CV, STRONG_CV), TODAY)
    scored = scored.withColumn("owner_id", F.concat(F.lit("o"), "doc_id"))
    runs = {"all": scored, "second": scored.filter("doc_id < 2"), "only two": scored.filter("doc_id = 2")}
    for run, df in runs.items():
        sinks.write_reviews(df, target, TODAY, run_id=run)
    before = _times(target)
    erased = spark.createDataFrame([("owner", "o2"), ("document", "77"), ("review", "unknown")], "kind string, id string")
    touched = sinks.erase_stored(spark, target, erased)
    assert sorted(run for _, run in touched) == ["all", "only two"]
    after = _times(target)
    assert {p for p in before if "run_id=second" in p} <= set(after) and all(after[p] == t for p, t in before.items() if p in after)
    assert not any("run_id=only" in p for p in after)
    for name in ("reviews", "findings", "category_scores", "priorities"):
        table = spark.read.parquet(f"{target}/{name}")
        assert {(r.run_id, r.doc_id) for r in table.select("run_id", "doc_id").distinct().collect()} == {(x, i) for x in ("all", "second") for i in (0, 1)}
    kept = _times(target)
    assert sinks.erase_stored(spark, target, erased) == [] and _times(target) == kept  # a repeat finds nothing left


def test_an_interrupted_erasure_is_finished_by_a_repeat(spark, docs_of, tmp_path, monkeypatch):
    target = str(tmp_path / "store")
    scored = corpus.score_corpus(docs_of(STRONG_CV, WEAK_CV), TODAY).withColumn("owner_id", F.concat(F.lit("o"), "doc_id"))
    sinks.write_reviews(scored, target, TODAY, run_id="r")
    erased = spark.createDataFrame([("owner", "o1")], "kind string, id string")
    monkeypatch.setattr(sinks, "CHILDREN", ("findings",))  # the work stops after the first child table
    real = sinks._stored
    monkeypatch.setattr(sinks, "_stored", lambda s, t, n, seen=[]: seen.append(n) or (real(s, t, n) if seen.count("reviews") < 2 else None))
    sinks.erase_stored(spark, target, erased)
    monkeypatch.undo()
    sinks.erase_stored(spark, target, erased)
    for name in ("reviews", "findings", "category_scores", "priorities"):
        assert {r.doc_id for r in spark.read.parquet(f"{target}/{name}").collect()} == {0}


# --- cubes -----------------------------------------------------------------------------------


def test_cube_by_force(tables):
    reviews = tables["plain"][0].withColumn("kind", F.when(F.col("review_id") % 3 == 0, None).otherwise(F.col("review_id") % 3))
    got = {(r.owner_id, r.kind, r.grouping_id): (r.n, r.best, r.mean, r.documents) for r in hs.review_cube(reviews, ["owner_id", "kind"]).collect()}
    rows = [r for r in reviews.collect() if r.status == "complete"]
    want = {}
    for bits in range(4):
        for r in rows:
            key = (None if bits & 2 else r.owner_id, None if bits & 1 else r.kind, bits)
            want.setdefault(key, []).append(r)
    assert set(got) == set(want)
    for key, members in want.items():
        n, best, mean, documents = got[key]
        assert (n, best) == (len(members), max(r.overall for r in members))
        assert abs(mean - sum(r.overall for r in members) / n) < 1e-9
        exact = len({r.doc_id for r in members})
        assert abs(documents - exact) <= max(1, 4 * hs.SKETCH_ERROR * exact)


# --- repeated uploads ------------------------------------------------------------------------


def _uploads(seed=5):
    """Bursts of equal uploads within half an hour, six hours apart."""
    r, rows = random.Random(seed), []
    for i in range(40):
        owner, text = f"o{r.randrange(3)}", f"t{r.randrange(4)}"
        for _ in range(r.randint(1, 4)):
            rows.append((owner, text, T0 + dt.timedelta(hours=6 * i, seconds=r.randrange(1800)), len(rows)))
    return rows


SCHEMA = "owner_id string, text_hash string, ts timestamp, upload_id bigint"


def bursts(rows):
    return sorted((o, h, int((ts - T0).total_seconds() // 21600)) for o, h, ts, _ in rows)


def test_repeats_in_a_table(spark):
    rows = _uploads()
    got = [tuple(r) for r in up.distinct_uploads(spark.createDataFrame(rows, SCHEMA), "ts", "upload_id", 3600).select("owner_id", "text_hash", "ts", "upload_id").collect()]
    assert bursts(got) == sorted(set(bursts(rows)))
    last, want = {}, []
    for o, h, ts, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if (o, h) not in last or ts - last[o, h] > dt.timedelta(hours=1):
            last[o, h] = ts
            want.append(i)
    assert sorted(want) == sorted(i for *_, i in got)


def _streamed(spark, tmp_path, rows, make):
    """Result of a stream that gets the rows in shuffled micro-batches, a day of event time each."""
    last = [("end", "end", T0 + dt.timedelta(days=99), -1)]
    ordered = sorted(rows, key=lambda r: r[2])
    for n, batch in enumerate([*(ordered[k : k + 25] for k in range(0, len(ordered), 25)), last]):
        random.Random(n).shuffle(batch)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (
        make(stream).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination(240)
    return {r.upload_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} - {-1}


def test_repeats_in_a_stream_of_shuffled_batches(spark, tmp_path):
    # Every burst has a text of its own, so that all its repeats lie within the watermark.
    rows = [(o, f"{h}-{int((ts - T0).total_seconds() // 21600)}", ts, i) for o, h, ts, i in _uploads()]
    kept = _streamed(spark, tmp_path, rows, lambda s: up.distinct_uploads_stream(s, "ts", "1 hour"))
    batch = {r.upload_id for r in up.distinct_uploads(spark.createDataFrame(rows, SCHEMA), "ts", "upload_id", 3600).collect()}
    key = {i: (o, h) for o, h, _, i in rows}
    # Which of the equal uploads arrives first is up to the batches; that one of each stays is not.
    assert len(kept) == len(batch) < len(rows) and {key[i] for i in kept} == {key[i] for i in batch}


def test_exact_repeats_in_a_stream_equal_the_batch(spark, tmp_path):
    rows = _uploads()
    kept = _streamed(spark, tmp_path, rows, lambda s: up.exact_uploads_stream(s, "ts", "upload_id", 3600, "1 day"))
    assert kept == {r.upload_id for r in up.distinct_uploads(spark.createDataFrame(rows, SCHEMA), "ts", "upload_id", 3600).collect()}
