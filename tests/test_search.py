import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import dense, fusion, lexical, search
from tessella.operators.prompt import contexts
from tessella.operators.rerank import model_score, rerank
from tessella.schema import META

CHUNK = f"id string, source string, title string, content string, metadata map<string,{META}>, chunk_ord bigint"


def bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {i: t.lower().split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    return {i: s for i, t in toks.items() if (s := sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in query.lower().split())) > 0}


def test_bm25_equals_formula(spark):
    rng = random.Random(3)
    docs = {f"d{i}": " ".join(rng.choice("common common rare1 rare2 rare3 x y z".split()) for _ in range(rng.randint(1, 30))) for i in range(30)} | {"blank": " "}
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    queries = {1: "common rare1", 2: "rare2 rare2 z", 3: "absent", 4: ""}
    q = spark.createDataFrame(list(queries.items()), "query_id int, text string")
    got = {}
    index = lexical.build_index(df)
    for r in lexical.bm25_search(index, q, 100).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
    for k, text in queries.items():
        assert got.get(k, {}) == pytest.approx(bm25(docs, text), abs=1e-6)
    for block, parts in ((2, 5), (1, 1)):  # several blocks of queries, several tasks
        best = lexical.bm25_search(index._replace(texts=index.texts.repartition(parts)), q, 3, block=block).collect()
        for k, text in queries.items():
            s = {i: round(x, 6) for i, x in bm25(docs, text).items()}
            assert [r.id for r in sorted(best, key=lambda r: r.rank) if r.query_id == k] == sorted(s, key=lambda i: (-s[i], i))[:3]
    assert {(r.term, r.id, r.tf, r.dl) for r in lexical.postings(index).where("id = 'd0'").collect()} == {(w, "d0", docs["d0"].split().count(w), len(docs["d0"].split())) for w in docs["d0"].split()}
    assert lexical.bm25_search(lexical.build_index(df.limit(0)), q).count() == 0 and lexical.bm25_search(index, q.limit(0)).count() == 0


def test_common_term_makes_no_rows(spark):
    """A term that every text and every query has: what leaves the tasks is k rows per query and task."""
    docs = spark.range(2000, numPartitions=4).selectExpr("cast(id as string) id", "concat('all w', id) content")
    q = spark.range(50).selectExpr("id query_id", "concat('all w', id) text")
    index = lexical.build_index(docs)
    rows = []
    real, lexical.top_k = lexical.top_k, lambda df, k: rows.append(df.count()) or real(df, k)
    try:
        assert lexical.bm25_search(index, q, 5).count() <= 250
    finally:
        lexical.top_k = real
    assert rows[0] <= 50 * (5 + 8) * 8


def test_term_that_most_have(spark):
    docs = spark.createDataFrame([(str(i), "all" if i else "all one two") for i in range(5)], "id string, content string")
    idf = {r.term: r.idf for r in lexical.build_index(docs).terms.collect()}
    assert idf["all"] == pytest.approx(0.25 * (math.log(0.5) - math.log(5.5) + 2 * (math.log(4.5) - math.log(1.5))) / 3)


@pytest.mark.parametrize("block", [4096, 2])
def test_dense_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 8)).astype(np.float32)
    m[50] = m[51] = m[52]  # ties
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(999, None)], "id bigint, embedding array<float>").repartition(5)
    q = v.where("id % 40 = 0 or id = 52 or id = 999").select(F.col("id").alias("query_id"), "embedding")
    got = {}
    for r in dense.dense_search(v, q, 7, block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for k, found in got.items():
        s = np.round(m.astype(float) @ m[k].astype(float), 6)
        assert [i for _, i in sorted(found)] == sorted(range(200), key=lambda i: (-s[i], i))[:7]
    assert 999 not in got
    assert dense.dense_search(v.limit(0), q, 3).count() == 0 and dense.dense_search(v, q.limit(0), 3).count() == 0


def test_fusion(spark):
    lists = lambda *x: spark.createDataFrame([("q", i, r) for r, i in enumerate(x, 1)], "query_id string, id string, rank int")
    got = {r.id: (r.rank, r.score) for r in fusion.fuse({"dense": lists("a", "b"), "bm25": lists("b", "c")}, 10).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == ["b", "a", "c"]
    assert got["a"][1] == pytest.approx(1 / 60 + 1 / 1060) and got["b"][1] == pytest.approx(1 / 61 + 1 / 60) and got["c"][1] == pytest.approx(1 / 1060 + 1 / 61)
    three = fusion.reciprocal_ranks({"x": lists("a"), "y": lists("a"), "z": lists("b")}).collect()
    assert {r.id: r.score for r in three} == pytest.approx({"a": 2 / 60 + 1 / 1060, "b": 1 / 60 + 2 / 1060})


def test_near_duplicates(spark):
    rows = [("q", "r0", "a b c d", 1, 0.5), ("q", "r1", "x y", 2, 0.5), ("q", "r2", "a b c d e", 3, 0.4), ("q", "r3", "b c d e f", 4, 0.3), ("q", "n", None, 5, 0.1), ("q", "e", "", 6, 0.1)]
    hits = spark.createDataFrame(rows, "query_id string, id string, content string, rank int, score double")
    got = {r.id: (r.group_size, r.score) for r in fusion.group_near_duplicates(hits, 0.6).collect()}
    # r3 is like r2 but not like r0, and joins their group.
    assert got["r0"][0] == 3 and got["r0"][1] == pytest.approx(0.5 + 1 / 60 + 1 / 61 + 1 / 62)
    assert got["r1"] == (1, pytest.approx(0.5 + 1 / 60)) and got["n"][0] == 2 and set(got) == {"r0", "r1", "n"}


@pytest.fixture(scope="module")
def chunks(spark):
    meta = lambda **m: {k: ("str", v, None, v.lower()) for k, v in m.items()}
    return spark.createDataFrame([
        ("git:api:a1:0", "git", "api: Auth flow", "Auth flow validates sessions. " + "x" * 100, meta(author="alice", date="2026-05-10 12:00:00 +0200"), 0),
        ("git:api:b2:0", "git", "api: old", "auth removed", meta(author="Alice", date="2026-04-01"), 1),
        ("slack:c:1:0", "slack", "#c: hi", "nothing here", meta(date="2026-05-11"), 2), ("pin:1:0", "pin", None, None, {}, 3),
    ], CHUNK)


def test_grep(chunks):
    o = search.Options(source="git", filters={"author": "ALICE"}, after="2026-05-01", before="2026-06-01")
    r = search.grep(chunks, "auth", 10, o, 80).collect()
    assert len(r) == 1 and r[0].id == "git:api:a1:0" and r[0].snippet.endswith("...") and len(r[0].snippet) == 83 and r[0].total_matches == 1
    assert [x.rank for x in search.grep(chunks, "AUTH", 1).collect()] == [1] and search.grep(chunks, "AUTH", 1).first().total_matches == 2
    assert search.grep(chunks, "absent").count() == 0
    assert {r.source: r.matches for r in search.grep_counts(chunks, "auth").collect()} == {"git": 2}


def test_search_and_fold(spark, chunks):
    q = spark.createDataFrame([("q", "auth flow removed")], "query_id string, text string")
    hits = search.search(chunks, q, search.Options(top_k=2))
    r = hits.orderBy("rank").collect()
    assert [x.id for x in r] == ["git:api:a1:0", "git:api:b2:0"] and r[0].rerank_score == pytest.approx(2 / 3)
    assert search.search(chunks, q, search.Options(source="slack")).count() == 0
    assert search.record_hits(hits, 5).where("record_id = 'git:api:a1'").count() == 1 and search.record_hits(hits, 0).count() == 0
    assert contexts(hits).first().context.startswith("[1] Source: api: Auth flow (git)\nAuth flow")
    assert search.search(chunks, q, search.Options(dedup_threshold=0.9)).count() == 2


def test_scores(spark):
    df = spark.createDataFrame([(0.0, 0.25, 0.1, 0.2), (-0.3, 0.25, 0.1, 0.2), (0.0, 0.0, 0.1, 0.2)], "a double, b double, c double, d double")
    assert [r.y for r in df.select(search.hit_score(*map(F.col, "abcd")).alias("y")).collect()] == [0.25, -0.3, 0.2]


def test_model_reranker(spark):
    df = spark.createDataFrame([("q", "a", "text", "long content"), ("q", "b", "text", "x")], "query_id string, id string, query string, content string")
    r = rerank(df, 1, model_score(lambda pairs: [float(len(c)) for _, c in pairs])).collect()
    assert [(x.id, x.rerank_score) for x in r] == [("a", 12.0)]
