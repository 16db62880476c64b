import duckdb
import pytest

from tests.llm.conftest import SMALL
from trajspark.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = QUERIES[name](spark, SMALL)
    names = sorted(found.columns)
    expected = con.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == names
    ours = sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)
    theirs = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall(), key=repr)
    assert len(ours) == len(theirs)
    for mine, other in zip(ours, theirs):
        for a, b in zip(mine, other):
            assert a == b or (isinstance(a, float) and abs(a - b) <= 1e-9 * max(1, abs(a)))
