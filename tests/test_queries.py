"""Every registered domain query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from breakweave.plans import queries as plans
from jobs import queries as jobs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or str(v) in ("<NA>", "NaT"):
            return "-"
        if isinstance(v, (float, np.floating)):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


QUERIES, SQL = plans.QUERIES | jobs.QUERIES, plans.ORACLES | jobs.SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object)) == rows(want.astype(object))


def test_entry_imports_and_lists(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_running_ids_beyond_six_digits(spark, duck, tmp_path):
    """The SQL's lpad cuts a seventh digit; the query gives what the SQL gives, the operator the whole number."""
    duck.sql(f"copy (select * replace (event_id + 999990 as event_id) from events) to '{tmp_path}/events.parquet' (format parquet)")
    own = duckdb.connect()
    own.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    got, want = plans.normalize_cigar(spark, str(tmp_path)).toPandas(), own.sql(SQL["normalize_cigar"]).df()
    assert rows(got.astype(object)) == rows(want.astype(object))
    whole = plans.merge.normalize_cigar(plans.adapter(spark, str(tmp_path), "raw_candidates")).where("candidate_id like 'CIGAR%'")
    assert whole.agg(plans.F.max(plans.F.length("candidate_id"))).first()[0] == len("CIGAR_1000000")
