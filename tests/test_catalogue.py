"""Every catalogue query runs; those with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from patrolkit.plans import catalogue, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return made


def plain(rows, names):
    out = []
    for row in rows:
        values = dict(zip(names, row, strict=True))
        out.append(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for _, v in sorted(values.items())))
    return sorted(out)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    rows = df.collect()
    sql = oracle.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(got.fetchall(), names)


def test_entry_guards_absent_text_operators():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(oracle.oracle_sql()) <= set(entry.oracle_sql())
