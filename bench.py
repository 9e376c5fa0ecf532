"""Headline queries on one data set; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  Every query
runs whole to a sink that discards rows.  Each is run once on the same data to
warm the JVM and then timed, plan building included.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitalens.operators import history as hs  # noqa: E402
from vitalens.operators import layout as ly  # noqa: E402
from vitalens.operators import matching as mt  # noqa: E402
from vitalens.plans import corpus  # noqa: E402
from vitalens.plans.queries import QUERIES, doc_requests  # noqa: E402
from vitalens.session import local_session  # noqa: E402
from vitalens.sources import ingest  # noqa: E402
from vitalens.sources import tables as tb  # noqa: E402


def clean_and_score(spark, d):
    return corpus.score_corpus(ingest.clean_documents(tb.documents(spark, d)), tb.TODAY)


def score_cv(spark, d):
    return corpus.score_corpus(tb.cv_docs(spark, d), tb.TODAY)


def match(spark, d):
    docs = tb.documents(spark, d)
    postings = tb.postings(spark, d)
    return mt.match_report(docs, postings, doc_requests(docs, postings))


HEADLINE = {
    "clean_and_score_documents": clean_and_score,
    "build_and_score_cv": score_cv,
    "match_documents_postings": match,
    "posting_terms": lambda s, d: mt.posting_terms(tb.cv_postings(s, d)),
    "owner_stats": lambda s, d: hs.owner_stats(tb.ev_reviews(s, d), tb.ev_docs(s, d)),
    "baselines": lambda s, d: hs.baselines(tb.ev_reviews(s, d)),
    "document_deltas": lambda s, d: hs.document_deltas(tb.ev_reviews(s, d)),
    "compare_reviews": QUERIES["compare_reviews"],
    "throttle": QUERIES["st1_throttle"],
    "two_column_pages": lambda s, d: ly.multi_column_counts(tb.word_boxes(s, d)),
    "table_rows": lambda s, d: ly.table_rows(tb.cells(s, d)),
}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    only = set(sys.argv[1:])
    times: dict[str, float] = {}
    for name, run in HEADLINE.items():
        if only and name not in only:
            continue
        for attempt in range(2):
            t0 = time.perf_counter()
            run(spark, d).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
            print(name, "warm-up" if attempt == 0 else "timed", times[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": d.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
