"""Every query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from sitelens.plans import audit
from sitelens.plans.registry import REGISTRY

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "events", "customer", "orders", "nation"):
        tail = "/*.parquet" if Path(f"{DATA}/{name}.parquet").is_dir() else ""
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet{tail}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_table_of_facts(spark):
    """Facts are made once for the queries that read them."""
    made = audit.facts(spark, DATA).cache()
    whole, audit.facts = audit.facts, lambda spark, d: made
    yield
    audit.facts = whole


def _key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", REGISTRY)
def test_matches_sql(spark, db, name):
    query, sql = REGISTRY[name]
    df = query(spark, DATA)
    if sql is None:
        assert df.count()
        return
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert got
