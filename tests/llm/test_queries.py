import os
from collections import Counter

import pytest

from tessella.llm import queries

from ..conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in "documents eval_items messages users git records chunks ingest_config".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sql, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = sql.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    expected = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == expected


def test_every_query_without_sql_has_rows(spark):
    """Those that SQL can't say are tested against brute force, round trips or held-out lines in the other files."""
    rest = queries.queries().keys() - queries.oracle_sql().keys()
    assert rest == {"p2_found", "p2_spans", "p2_redacted", "p4_pieces", "p5_found", "p5_replaced", "p6_ids", "p8_found", "p8_restored"}
