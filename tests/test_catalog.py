"""Registered graph queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lexiweave.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
SLOW = {"pagerank_10", "plain_pagerank_10", "edge_importance", "reduce_sizes", "tournament", "simulate_games", "simulate_target_games", "weighted_games", "chain_edges"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8))
    return str(v)


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = db.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want


def test_entry_module_without_corpus_operators():
    """Nothing outside the subpackage imports it."""
    root = Path(catalog.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f
