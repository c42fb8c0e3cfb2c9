import os
from collections import Counter

import pytest

from tessella.plans import workload

from .conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
duckdb = pytest.importorskip("duckdb")
TABLES = "documents embeddings messages users channels git records chunks events region nation customer".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_query(spark, sql, name):
    df = workload.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = sql.execute(workload.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_every_query_has_sql():
    assert workload.queries().keys() == workload.oracle_sql().keys()


def test_catalog_queries_take_all_records(spark, sql):
    q = workload.queries()
    ids = {r[0] for r in sql.execute("SELECT DISTINCT id FROM records").fetchall()}
    gone = {r[0] for r in sql.execute("SELECT id FROM records WHERE source = 'git'").fetchall()}
    assert {r.id for r in q["catalog_delete"](spark, DATA).collect()} == ids - gone
    picked, left = ({r.id for r in q[f"catalog_{k}"](spark, DATA).collect()} for k in ("select", "clear"))
    assert picked | left == ids and not picked & left


def test_record_hits_cover_every_source(spark, sql):
    of = dict(sql.execute("SELECT id, any_value(source) FROM chunks GROUP BY id").fetchall())
    hit = {of[r.id] for r in workload.queries()["record_hits"](spark, DATA).collect()}
    assert len(hit - {"git"}) > 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q = workload.queries()
    p = plan(q["grep_counts"](spark, DATA))
    assert "ReadSchema: struct<text:string,source:string>" in p or "ReadSchema: struct<source:string,text:string>" in p, "only the columns that are needed"
    assert "WindowGroupLimit" in plan(q["bm25_batch_topk"](spark, DATA)), "only k rows of each task are shuffled"
    p = plan(q["filter_date_range"](spark, DATA))
    assert "PushedFilters" in p
    assert "CartesianProduct" not in "".join(plan(f(spark, DATA)) for f in q.values())
