import duckdb
import pytest

from tallyforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "sales"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_names():
    ops = {n.split("_")[0] for n in queries.QUERIES if n.startswith("op")}
    assert ops == {f"op{k}" for k in range(1, 14)} and "pipeline" in queries.QUERIES
