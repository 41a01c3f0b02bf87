"""Every registered query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from noticemill.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_notice_by_id_has_the_state(spark):
    (row,) = QUERIES["notice_by_id"](spark, SF).collect()
    (state,) = QUERIES["deadline_state"](spark, SF).where("id = 7").collect()
    assert (row.id, row.estado) == (7, state.estado) and "estado" in ORACLE_SQL["notice_by_id"].rsplit("SELECT", 1)[1]
