"""Every core query against its SQL twin on the smallest tables, and the shape of the driver contract."""

from pathlib import Path

import duckdb
import pytest

from cuewright.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows) if not any(None in r for r in rows) else sorted((tuple(show(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in registry.oracles():
        assert len(set(df.columns)) == len(df.columns)
        return
    cur = duck.execute(registry.oracles()[name])
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.columns, got) == canon(columns, want)


def test_entry_without_text_problems():
    assert set(registry.oracles()) <= set(registry.queries())
