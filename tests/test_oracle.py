"""Every query against its DuckDB oracle on the smallest data set."""

import oracle_check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.fixture(scope="module", autouse=True)
def shared_career_documents(spark):
    """Build the career documents once; most queries start from them."""
    from vitalens.sources import tables as tb

    original = tb.cv_docs
    docs = original(spark, SF).cache()
    tb.cv_docs = lambda s, d: docs if d == SF else original(s, d)
    yield
    tb.cv_docs = original


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    result = oracle_check.compare(spark, con, name, SF)
    assert result.startswith(("ok", "rows-only")), result


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
