"""Every registered query of the engine's own operators against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gleanwell.plans import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    if name in registry.ORACLES:
        rel = con.sql(registry.ORACLES[name])
        assert sorted(rel.columns) == cols
        assert got == sorted(str(x) for x in rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_nothing_outside_imports_the_optional_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in glob.glob(f"{root}/gleanwell/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            assert "llm" not in open(p).read(), p
