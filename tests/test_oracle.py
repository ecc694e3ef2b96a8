"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from leafmill import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else v if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted([tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=str)
    out = duck.sql(registry.ORACLES[name])
    at = [out.columns.index(c) for c in sorted(df.columns)]
    assert len(out.columns) == len(at)
    want = sorted([tuple(norm(r[i]) for i in at) for r in out.fetchall()], key=str)
    assert got == want
