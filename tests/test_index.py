import json
import shutil
import threading
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from tessella import cli, config
from tessella.index import Index
from tessella.operators import collection
from tessella.operators.providers import HashEmbedder
from tessella.server import handle, run_search, serve
from tessella.store import Store


def rec(i, content, source="wiki", **meta):
    return {"id": i, "source": source, "content": content, "title": f"Title {i}", "metadata": meta}


class Counting(HashEmbedder):
    """Counts across processes: every text leaves a line."""

    def __init__(self, path):
        super().__init__()
        self.path = str(path)

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.writelines("x\n" for _ in texts)
        return super().embed(texts)


def test_store_publishes_as_a_whole(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert not s.exists() and not s.exists("a")
    with pytest.raises(FileNotFoundError):
        s.read("a")
    with pytest.raises(ValueError):
        s.publish({})
    s.publish({"a": spark.range(3), "b": spark.range(1)})
    old = s.read("a")
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception):
        s.publish({"a": spark.range(9), "b": bad})
    assert s.read("a").count() == 3 and s.exists("a", "b") and not s.exists("c")
    for n in (5, 6):
        s.publish({"a": spark.range(n)})
    assert s.read("a").count() == 6 and not s.exists("b")
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("v-")]) == 2
    with pytest.raises(Exception):
        old.count()
    s.clear()
    assert not s.exists()


def test_life_of_an_index(spark, tmp_path):
    seen = tmp_path / "embedded"
    seen.touch()
    index = Index(spark, str(tmp_path / "i"), [Counting(seen)])
    count = lambda: len(seen.read_text().splitlines())
    assert not index.exists() and index.count_records() == 0
    assert index.upsert_records([rec("article:with:colon", "the auth flow validates sessions", status=2), rec("a2", "unrelated words here"), rec("v1", "the auth flow validates sessions", "video", status="2")]) == 3
    assert index.exists() and count() == 2, "equal contents are embedded once"
    assert [r.id for r in index.list_record_ids(filters=["status=2"]).collect()] == ["article:with:colon", "v1"]
    hits = index.search_records("auth flow", 3).orderBy("record_rank").collect()
    assert {h.record_id for h in hits[:2]} == {"article:with:colon", "v1"} and hits[0].score > 0
    assert index.search_records("auth", 0).count() == 0
    before = count()
    index.upsert_records([rec("a2", "changed words"), rec("a3", "the auth flow validates sessions")])
    assert count() == before + 1, "only what is new is embedded"
    assert [r.id for r in index.list_record_ids().collect()] == ["article:with:colon", "a2", "v1", "a3"]
    assert index.fetch_records_metadata(["v1", "none", "article:with:colon"]) == {"v1": {"id": "v1", "source": "video", "title": "Title v1", "content": "the auth flow validates sessions", "status": "2"}, "article:with:colon": {"id": "article:with:colon", "source": "wiki", "title": "Title article:with:colon", "content": "the auth flow validates sessions", "status": 2}}
    r = index.query("changed", top_k=1)
    assert [x.id for x in r.sources] == ["a2:0"] and r.answer == "" and "search" in r.timings
    status, body = handle(index, "/search?q=AUTH&n=2&filter=status%3D2&metadata=1")
    assert status == 200 and body["total_matches"] == 2 and {x["id"] for x in body["results"]} == {"article:with:colon:0", "v1:0"} and body["results"][0]["metadata"]["status"] == "2"
    status, body = handle(index, "/search?q=changed&mode=hybrid&n=1&full=1")
    assert status == 200 and body["results"][0]["content"] == "changed words" and body["results"][0]["rerank"] == 1.0
    status, body = handle(index, "/search?q=auth%20flow&mode=semantic&n=3&scores=1&context=24")
    dense = index.semantic(index._one("auth flow"), 3).orderBy("rank").collect()
    assert status == 200 and [(x["id"], x["score"]) for x in body["results"]] == [(r.id, round(r.score, 3)) for r in dense], "order and score are the dense ones"
    assert [round(r.score, 3) for r in dense] == sorted((round(r.score, 3) for r in dense), reverse=True) and "rerank" not in body["results"][0]
    export = str(tmp_path / "export")
    index.export_records(export)
    again = Index(spark, str(tmp_path / "again"), [Counting(seen)])
    assert again.upsert_records(collection.read_records(spark, export).withColumnRenamed("ord", "src_ord")) == 4
    assert [(r.id, r.content, r.metadata) for r in again.records().collect()] == [(r.id, r.content, r.metadata) for r in index.records().collect()], "kinds of metadata come back"
    assert {r.id: r.chunks for r in index.documents().collect()} == {"article:with:colon": 1, "a2": 1, "v1": 1, "a3": 1}
    assert index.delete_records(["a2", "none"]) == 1 and index.clear_records("video") == 1 and index.count_records() == 2
    assert index.clear_records() == 2 and not index.exists()


def test_only_changed_records_are_cut_again(spark, tmp_path, monkeypatch):
    from tessella import index as module

    index = Index(spark, str(tmp_path / "i"), max_chunk_tokens=8, chunk_overlap_tokens=2)
    index.upsert_records([rec(f"r{k}", f"words of number {k} " * 6) for k in range(5)])
    cut = []
    real = module.chunk_documents
    monkeypatch.setattr(module, "chunk_documents", lambda docs, *a: cut.append({r.id for r in docs.collect()}) or real(docs, *a))
    index.upsert_records([rec("r1", "other words now " * 6), rec("r9", "new words")])
    index.delete_records(["r3"])
    assert cut == [{"r1", "r9"}, set()]
    whole = Index(spark, str(tmp_path / "w"), max_chunk_tokens=8, chunk_overlap_tokens=2)
    whole.upsert_records(index.records().withColumnRenamed("ord", "src_ord"))
    table = lambda i, t: sorted(map(str, i.store.read(t).collect()))
    for t in ("chunks", "terms", "stats"):
        assert [tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in index.store.read(t).orderBy(index.store.read(t).columns[0]).drop("metadata").collect()] == [tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in whole.store.read(t).select(index.store.read(t).columns).orderBy(index.store.read(t).columns[0]).drop("metadata").collect()]
    assert table(index, "vectors_local--hash") == table(whole, "vectors_local--hash")


def test_writers_exclude_each_other(spark, tmp_path):
    s, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    with s.locked():
        with s.locked():
            s.publish({"a": spark.range(2)})
        with pytest.raises(TimeoutError):
            other.locked(timeout=0.3).__enter__()
    other.publish({"a": spark.range(3)})
    assert s.read("a").count() == 3
    (tmp_path / "s" / "LOCK").touch()
    with other.locked(timeout=5, stale=-1):
        pass
    with pytest.raises(ValueError):
        with s.locked():
            raise ValueError
    with other.locked(timeout=0.3):
        pass


def test_concurrent_upserts_lose_nothing(spark, tmp_path):
    both = [Index(spark, str(tmp_path / "i")) for _ in range(2)]
    threads = [threading.Thread(target=i.upsert_records, args=([rec(f"r{k}", f"content {k}")],)) for k, i in enumerate(both)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert {r.id for r in both[0].records().collect()} == {"r0", "r1"}


def test_evaluation_with_a_saved_report(spark, tmp_path):
    from tessella.index import forget, opened

    path = str(tmp_path / "i")
    index = opened(spark, path)
    assert opened(spark, path) is index
    forget()
    assert opened(spark, path) is not index
    index.upsert_records([rec("a", "ABC-12 the login fails", "atlassian") | {"title": "ABC-12: Login fails on Mondays"}, rec("b", "fix login ABC-12", "git"), rec("c", "other words", "wiki"), rec("d", "DEF-1 alone", "wiki"), *(rec(f"e{k}", f"more of other words {k}", "wiki") for k in range(4))])
    out = {r.stage: r for r in index.evaluate(str(tmp_path / "eval.json")).collect()}
    assert set(out) == {"dense", "bm25", "rrf", "rerank"} and out["bm25"].source_recall == 1.0 and out["bm25"].n_hits == 2
    (case,) = json.loads((tmp_path / "eval.json").read_text())
    assert case["entity_key"] == "ABC-12" and case["query"] == "Login fails on Mondays" and case["expected_sources"] == ["atlassian", "git"] and case["n_ground_truth"] == 2
    assert case["stages"]["rerank"]["n_hits"] == 2 and case["stages"]["bm25"]["sources_found"] == ["atlassian", "git"]


def test_substring_search_before_an_index(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame([("a", "wiki", "The Auth flow", "t", None, 0, 1), ("b", "wiki", "none", "t", None, 0, 2)], "id string, source string, content string, title string, metadata map<string,struct<kind:string,s:string,d:double,cf:string>>, source_rank int, src_ord bigint")
    got = run_search(index, "auth", docs=docs)
    assert [r["id"] for r in got["results"]] == ["a"] and got["total_matches"] == 1


def test_cache_begins_with_the_index(spark, tmp_path):
    seen = tmp_path / "embedded"
    seen.touch()
    index = Index(spark, str(tmp_path / "i"), [Counting(seen)])
    index.upsert_records([rec("a", "one"), rec("b", "two")])
    shutil.rmtree(tmp_path / "i" / "cache")
    index.upsert_records([rec("c", "three")])
    assert len(seen.read_text().splitlines()) == 3, "the first two came from the index"
    assert [r.id for r in index.fetch_records(["c", "x", "a", "c"]).collect()] == ["c", "a"]


def test_index_is_fetched_once(spark, tmp_path):
    from tessella.index import fetched

    Index(spark, str(tmp_path / "i")).upsert_records([rec("a", "b")])
    assert fetched(spark, [str(tmp_path / "none"), str(tmp_path / "i")], str(tmp_path / "local")) == str(tmp_path / "i")
    with pytest.raises(FileNotFoundError):
        fetched(spark, [str(tmp_path / "none")], str(tmp_path / "local"))


def test_http_errors_and_parameters():
    said = {}

    def search(_, q, mode, n, **more):
        said.update(more, q=q, mode=mode, n=n)
        return {"results": []}

    url = "/search?q=a%20b&mode=semantic&n=7&source=git&filter=x%3D1&filter=y%3D2&after=2026-01-01&context=42&scores=0&metadata=true"
    assert handle(None, url, search) == (200, {"results": []})
    assert said == {"q": "a b", "mode": "semantic", "n": 7, "source": "git", "filters": ["x=1", "y=2"], "after": "2026-01-01", "before": None, "context": 42, "full": False, "scores": False, "metadata": True}
    assert handle(None, "/health") == (200, {"status": "ok"}) and handle(None, "/x")[0] == 404 and handle(None, "/search")[0] == 400
    status, body = handle(None, "/search?q=x&filter=not-a-filter")
    assert status == 400 and body["error"] == "Invalid filter: 'not-a-filter' (expected key=value or JSON object)"
    assert handle(None, "/search?q=x&mode=odd")[0] == 400 and handle(None, "/search?q=x&after=soon")[0] == 400 and handle(None, "/search?q=x&n=many")[0] == 400
    assert handle(None, "/search?q=x")[0] == 500


def test_server_answers():
    server = serve(None, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urlopen(f"http://127.0.0.1:{server.server_port}/health", timeout=10) as r:
        assert json.load(r) == {"status": "ok"}
    server.shutdown()


@pytest.mark.parametrize("argv, pipeline", [(["ingest"], True), (["--config", "x", "ingest"], True), (["auth"], False), (["-n", "5", "auth"], False), (["--", "ingest"], False), ([], False), (["stats", "x"], True), (["--config", "ingest"], False)])
def test_dispatch(argv, pipeline):
    assert cli.is_pipeline(argv) is pipeline


def test_cli_options():
    a = cli.search_parser().parse_args(["auth", "-n", "3", "-f", "a=1", "-f", "b=2", "--json"])
    assert a.mode == "hybrid" and a.n == 3 and a.filter == ["a=1", "b=2"] and a.context is None
    assert cli.pipeline_parser().parse_args(["inspect", "grep", "x"]).term == "x"
    assert cli.main(["scrape", "--source", "slack"]) == 2
    assert cli.show({"results": [{"rank": 1, "source": "s", "title": "t", "id": "i", "snippet": "n"}], "total_matches": 1}, False) == "1 matches\n1. [s] t  (i)\n   n"


def test_config(tmp_path, monkeypatch):
    p = tmp_path / "config.toml"
    p.write_text('[ingest]\nmax_chunk_tokens = 100\n[embedding]\nmodels = [{provider = "a", model_name = "b"}]\n[scrape.slack]\nany = 1\n')
    c = config.load(str(p))
    assert c.ingest.max_chunk_tokens == 100 and [dict(m) for m in c.models()] == [{"provider": "a", "model_name": "b", "device": "cpu"}] and c.scrape == {"slack": {"any": 1}}
    assert [dict(m) for m in config.Config().models()] == [{"provider": "local", "model_name": "hash", "device": "cpu"}]
    with pytest.raises(TypeError):
        config.from_mapping({"ingest": {"unknown": 1}})
    with pytest.raises(ValueError):
        config.from_mapping({"ingest": {"chunk_overlap_tokens": 600}})
    monkeypatch.setenv(config.ENV, str(p))
    assert config.find() == p
    monkeypatch.delenv(config.ENV)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    monkeypatch.chdir(tmp_path)
    assert str(config.find()) == "config.toml"
    (tmp_path / ".env").write_text("# c\nexport TESS_A='1'\nTESS_B=2\nbad\n")
    monkeypatch.setenv("TESS_B", "kept")
    assert config.load_env() == {"TESS_A": "1", "TESS_B": "2"}
    import os
    assert os.environ.pop("TESS_A") == "1" and os.environ["TESS_B"] == "kept"
