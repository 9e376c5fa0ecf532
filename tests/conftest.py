import os
import sys
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TODAY = date(2026, 8, 28)

STRONG_CV = """Dana Whitfield
Portland, OR | dana.whitfield@example.org | +1 503 555 0188 | linkedin.com/in/danaw | github.com/danaw

PROFESSIONAL SUMMARY
Platform engineer building payment systems used by millions of people.

EXPERIENCE
Staff Engineer, Northlake Systems | Mar 2021 - Present
- Led 6 engineers to rebuild billing, cutting errors by 38%
- Reduced p95 latency from 900ms to 210ms across the checkout path
- Designed a ledger processing 2M transactions per day without downtime
Engineer, Tallpine | Jan 2016 - Feb 2021
- Automated 14 deployments and saved 30 hours every month
- Built a fraud model that blocked $4M of losses in its first year

EDUCATION
BSc Computing, City University, 2010 - 2014

SKILLS
Python, PostgreSQL, Kafka, Airflow
"""

WEAK_CV = """my background
objective
i am a team player and a hard worker and we always think outside the box in my job

experience
Duties at the shop
- Responsible for various tasks
- Worked on reports
- Helped with the stock

Education
Some school
"""


@pytest.fixture(scope="session")
def spark():
    from vitalens.session import local_session

    s = local_session(8, "tests")
    s.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    yield s


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents (doc_id, cleaned text) from texts."""
    from pyspark.sql import functions as F

    from vitalens.functions import text as tx

    def make(*texts: str):
        rows = [(i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn(
            "text", tx.clean(F.col("text"))
        )

    return make


@pytest.fixture(scope="module", autouse=True)
def nothing_cached():
    """What one file of tests caches does not stand in the plans that another reads."""
    yield
    from pyspark.sql import SparkSession

    if (session := SparkSession.getActiveSession()) is not None:
        session.catalog.clearCache()
