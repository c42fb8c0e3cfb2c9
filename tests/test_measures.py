import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cache, evaluation, inspect, providers
from tessella.schema import META
from tessella.streaming import ingest as stream


def test_metrics_by_hand(spark):
    truth = spark.createDataFrame([("q", 1, "git"), ("q", 2, "git"), ("q", 5, "slack"), ("none", 9, "git")], "query_id string, id int, source string")
    hits = spark.createDataFrame([("q", 7, "git", 1), ("q", 2, "git", 2), ("q", 1, "git", 3)], "query_id string, id int, source string, rank int")
    got = {r.query_id: r for r in evaluation.metrics(hits, truth).collect()}
    assert got["q"].entity_recall == pytest.approx(2 / 3) and got["q"].mrr == 0.5 and got["q"].source_recall == 0.5 and got["q"].n_hits == 2 and got["q"].sources_found == ["git"]
    assert (got["none"].mrr, got["none"].n_hits, got["none"].entity_recall) == (0.0, 0, 0.0)
    s = evaluation.summary(evaluation.evaluate({"a": hits, "b": evaluation.cut(hits, 1)}, truth)).collect()
    assert {r.stage: r.n_hits for r in s} == {"a": 1.0, "b": 0.0}, "two right hits of one question and none of the other; none in the first place"


def test_entities(spark):
    rows = [("c1", "atlassian", "AB-1: The login is broken", "AB-1 AB-1 UTF-8"), ("c2", "git", "fix: AB-1 login", "see AB-1 and CD-22"), ("c3", "slack", "", "CD-22 HTTP-404 SHA-256"), ("c4", "git", "feat(CD-22 something longer", "CD-22"), ("c5", "slack", None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, source string, title string, content string, chunk_ord int")
    found = evaluation.mentions(df)
    e = {r.entity: (r.n_sources, r.mentions, r.n_chunks) for r in evaluation.entities(found).collect()}
    assert e == {"AB-1": (2, 3, 2), "CD-22": (2, 3, 3)}
    q = {r.query_id: r.text for r in evaluation.synthesized_queries(found, evaluation.entities(found)).collect()}
    assert q == {"AB-1": "The login is broken", "CD-22": "CD-22 something longer"}
    assert evaluation.synthesized_queries(found, evaluation.entities(found), 1).count() == 1
    assert {(r.query_id, r.id) for r in evaluation.labels(found).collect()} >= {("AB-1", "c1"), ("AB-1", "c2")}


def test_figures(spark):
    df = spark.createDataFrame([(str(i), "s" if i % 2 else None, "w" * i) for i in range(10)] + [("x", "s", "w"), ("n", "s", None)], "id string, source string, content string")
    assert {r.source: r.n for r in inspect.source_counts(df).collect()} == {"s": 7, None: 5}
    r = inspect.lengths(df.where("id not in ('x', 'n')")).first()
    assert (r.min_chars, r.median_chars, r.p90_chars, r.max_chars) == (0, 4, 8, 9)
    d = inspect.duplicates(df).first()
    assert (d.n_chunks, d.n_contents, d.n_repeats) == (12, 10, 2)
    t = {r.source: (r.docs, r.chunks) for r in inspect.docs_and_chunks(df.where("source = 's'"), df).collect()}
    assert t["TOTAL"] == (7, 12) and t["s"] == (7, 7)
    a, b = inspect.sample(df, 3, 1).collect(), inspect.sample(df.repartition(4), 3, 1).collect()
    assert a == b and len(a) == 3 and inspect.sample(df, 3, 2).collect() != a


def test_embedding_cache(spark):
    docs = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c"), ("4", None)], "id string, content string")
    empty = spark.createDataFrame([], cache.CACHE)
    e = providers.HashEmbedder(8)
    new = cache.fill(docs, empty, e)
    assert new.count() == 2 and cache.fill(docs, new, e).count() == 0
    assert cache.fill(docs, new, providers.HashEmbedder(8, "other")).count() == 2, "vectors belong to a model"
    v = {r.id: r.embedding for r in cache.assemble(docs, new.union(new), "local--hash").collect()}
    assert v["1"] == v["2"] and v["4"] is None and len(v["3"]) == 8 and np.linalg.norm(v["3"]) == pytest.approx(1)
    assert providers.model_key("a", "b/c d") == "a--b-c-d"


def test_pace_of_an_embedding_service():
    r = providers.EMBEDDING._replace(start=1.0, least=0.1)
    p = providers.started(r)
    for _ in range(3):
        p = providers.succeeded(p, r)
    assert p.interval == 0.75
    p = providers.refused(p, r)
    assert p.interval == p.floor == 1.125
    p = providers.refused(p, r, 10)
    assert p.interval == p.floor == 12 and p.hold == 10
    p = providers.refused(p, r, 500)
    assert p.interval == 90 and p.hold == 500
    for _ in range(10):
        p = providers.succeeded(p, r)
    assert p.floor == pytest.approx(76.5)


def test_pace_of_a_chat_service():
    r = providers.CHAT
    p = providers.started(r)
    for _ in range(30):
        p = providers.succeeded(p, r)
    assert 1 / p.interval == pytest.approx(8.4)
    for _ in range(9):
        p = providers.refused(p, r)
    assert 1 / p.interval == 1.0
    for _ in range(30 * 90):
        p = providers.succeeded(p, r)
    assert 1 / p.interval == pytest.approx(20.0)


def test_calls_are_spaced_and_refusals_kept():
    slept, clock = [], [0.0]
    paced = providers.Paced(providers.CHAT, lambda: clock[0], lambda s: (slept.append(s), clock.__setitem__(0, clock[0] + s)))
    answers = [1, providers.RateLimited(30), 2]

    def f():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert paced.call(f) == 1 and slept == []
    assert paced.call(f) == 2 and slept == [pytest.approx(1 / 8), 30.0]
    slow = providers.Paced(providers.EMBEDDING, lambda: 0.0, slept.append)
    assert slow.call(lambda: 3) == 3 and slept[-1] == 30.0


def test_throttled_embedder_and_batches():
    class Picky(providers.HashEmbedder):
        calls = 0

        def embed(self, texts):
            Picky.calls += 1
            if Picky.calls < 3:
                raise providers.RateLimited(1)
            return super().embed(texts)

    e = providers.Throttled(Picky(4), sleep=lambda s: None)
    assert e.embed(["a"]).shape == (1, 4) and Picky.calls == 3
    Picky.calls = -10
    with pytest.raises(providers.RateLimited):
        providers.Throttled(Picky(4), attempts=2, sleep=lambda s: None).embed(["a"])

    class Job:
        def __init__(self, after):
            self.after = after

        def collect(self, job):
            self.after -= 1
            return {"b": [0, 2], "a": [3, 4]} if self.after < 0 else None

    done = providers.collect_batches({"x": Job(0), "y": Job(2)}, sleep=lambda s: None)
    assert providers.in_order(done["x"], ["a", "b"]).tolist() == [[pytest.approx(0.6), pytest.approx(0.8)], [0, 1]]
    with pytest.raises(ValueError):
        providers.in_order(done["x"], ["a"])
    clock = iter(range(0, 1000, 100))
    with pytest.raises(TimeoutError, match="y"):
        providers.collect_batches({"x": Job(0), "y": Job(50)}, timeout=250, sleep=lambda s: None, now=lambda: next(clock))

    class Service:
        def submit(self, texts):
            self.texts = texts
            return "j"

        def collect(self, job):
            return {i: [len(t), 0] for i, t in reversed(self.texts.items())}

    assert providers.Batched(Service(), "p", "m").embed(["a", "bb"]).tolist() == [[1, 0], [1, 0]]


def test_a_run_that_fails_keeps_its_parts(spark, tmp_path):
    """Embedding goes on where it stopped: finished parts are in the cache."""
    docs = spark.createDataFrame([(str(i), f"text {i}") for i in range(40)], "id string, content string")
    folder = str(tmp_path / "cache")

    class Failing(providers.HashEmbedder):
        def embed(self, texts):
            if "text 7" in texts:
                raise OSError("service is gone")
            return super().embed(texts)

    with pytest.raises(Exception, match="gone"):
        cache.fill_folder(docs, folder, Failing(4), part=5)
    done = cache.read_folder(spark, folder).count()
    assert done < 40
    assert cache.fill_folder(docs, folder, providers.HashEmbedder(4), part=5) == 40 - done
    assert cache.fill_folder(docs, folder, providers.HashEmbedder(4)) == 0 and cache.read_folder(spark, folder).count() == 40


def test_stream_equals_batch(spark, tmp_path):
    import json

    from tessella.sources import normalize

    raw = tmp_path / "raw"
    raw.mkdir()
    put = lambda n, *rs: (raw / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rs))
    link = lambda i, t: {"title": t, "link": f"http://{i}", "channel_name": "c"}
    put("1", link(1, "one"), link(2, "two"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: stream.ingest_stream(stream.stream_raw(spark, str(raw), "bookmarks", 1), normalize.bookmarks, out, ck).awaitTermination()
    run()
    put("2", link(2, "two again"), link(3, "three"))
    run()
    run()
    assert sorted(r.title for r in stream.current(spark.read.parquet(out)).collect()) == ["one", "three", "two again"]

    spark.createDataFrame([], cache.CACHE).write.parquet(str(tmp_path / "cache"))
    schema = f"id string, source string, content string, title string, metadata map<string,{META}>, src_ord bigint"
    e = providers.HashEmbedder(4)
    for _ in range(2):
        stream.embed_stream(spark.readStream.schema(schema).parquet(f"{out}/batch=*"), str(tmp_path / "cache"), str(tmp_path / "ck2"), e).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 4


def test_windows_and_late_rows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 1.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = stream.activity(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("activity_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("activity_out").collect()) == [("a", 2, 3.0), ("b", 1, 1.0)]
    m = spark.createDataFrame([("c", "9"), ("c", "10"), ("c", "x")], "channel_id string, ts string")
    assert int(stream.high_water_stream(m).first().last_ts) == 10
