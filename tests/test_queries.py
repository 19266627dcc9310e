"""Every query of the library against its SQL on the smallest tables, and what SQL can't express against plain Python."""

import duckdb
import pytest

from ridgeline.plans import all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con():
    got = duckdb.connect()
    for t in TABLES.split():
        got.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return got


def plain(rows):
    return sorted(([float(x) if isinstance(x, float) else x for x in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    want = con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert len(got) == len(want) and plain(got) == plain(want)


def test_groups_of_chains(spark):
    from ridgeline.operators.groups import point_groups

    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (300, 300), (None, 4), (101, 100)]
    got = {r["node"]: r["root"] for r in point_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 300: 300}
    assert point_groups(spark.createDataFrame([], "a long, b long")).count() == 0
