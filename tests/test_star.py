import duckdb
import pytest

from lodestone.plans import archives, star

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted(repr(tuple(round(x, 4) if isinstance(x, float) else x for x in r)) for r in values)


QUERIES, ORACLES = star.QUERIES | archives.QUERIES, star.ORACLES | archives.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want)
