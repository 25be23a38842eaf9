import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from engram.plans import file_queries, learning_queries, sequence_queries, systems, text_queries, vector_queries  # noqa: E402, F401
from engram.plans.registry import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(repr(v) if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(con.sql(SQL[name]).df())
    else:
        assert len(got)
