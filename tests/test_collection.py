import pytest

from tessella.operators import collection as C
from tessella.schema import DOCUMENT


def rec(i, content="x", source="a", **meta):
    return {"id": i, "source": source, "content": content, "title": f"t {i}", "metadata": meta}


def state(spark, *items):
    return C.upsert(C.empty(spark), C.records_of(spark, list(items)))


def ids(df):
    return [r.id for r in df.orderBy("ord").collect()]


def test_upsert_keeps_places(spark):
    s = state(spark, rec("a1", status=2), rec("a2"), rec("a1", "again"))
    assert ids(s) == ["a1", "a2"] and s.where("id = 'a1'").first().content == "again"
    s = C.upsert(s, C.records_of(spark, [rec("new"), rec("a1", "third"), rec("newer")]))
    assert ids(s) == ["a1", "a2", "new", "newer"] and s.where("id = 'a1'").first().content == "third"
    assert ids(C.upsert(s, C.records_of(spark, []))) == ["a1", "a2", "new", "newer"]


def test_select_delete_clear(spark):
    s = state(spark, rec("a1", status=2), rec("v1", source="b", playlist="p1"), rec("v2", source="b", status="2"))
    assert ids(C.select_records(s, conditions={"status": 2})) == ["a1", "v2"]
    assert ids(C.select_records(s, "b", {"title": "T V1"})) == ["v1"]
    assert ids(C.delete(s, ["missing", "v1", "v1"])) == ["a1", "v2"]
    assert ids(C.clear(s, conditions={"playlist": "p1"})) == ["a1", "v2"] and ids(C.clear(s, "b", {"status": 2})) == ["a1", "v1"] and ids(C.clear(s, "b")) == ["a1"] and ids(C.clear(s)) == []
    assert [r.id for r in C.fetch(s, ["v2", "none", "a1", "v2"]).collect()] == ["v2", "a1"]
    f = C.flat_metadata(s).where("id = 'a1'").first().fields
    assert {k: v.s for k, v in f.items()} == {"id": "a1", "source": "a", "title": "t a1", "content": "x", "status": "2"}


@pytest.mark.parametrize("bad, error", [({"id": " ", "source": "a"}, ValueError), ({"id": "a", "source": ""}, ValueError), ({"id": "a", "source": "s", "content": 1}, TypeError), (rec("a", tags=[1]), TypeError), (rec("a", **{"title": "x"}), ValueError), (rec("a", n=None), TypeError), ({"source": "a"}, ValueError)])
def test_bad_records(spark, bad, error):
    with pytest.raises(error):
        C.records_of(spark, [bad])


def test_problems(spark):
    df = spark.createDataFrame([("a", "s", "c", "t", {}), (" ", "s", "c", "t", {}), ("b", None, "c", "t", {}), ("c", "s", None, "t", {}), ("d", "s", "c", None, {}), ("e", "s", "c", "t", C.metadata_of({"x": 1}) | {"id": ("str", "x", None, "x")}), ("f", "s", "c", "t", None)], DOCUMENT)
    assert sorted(r.id for r in C.problems(df).collect()) == [" ", "b", "c", "d", "e"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "source": "s", "content": "c", "title": "t", "metadata": {"n": 1}}\n\n{"id": "b", "source": "s", "content": "", "title": "", "metadata": null}\n')
    got = C.read_records(spark, str(tmp_path / "r.jsonl")).orderBy("ord").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].metadata["n"].s == "1" and got[1].metadata == {}
    assert C.read_records(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_numbering(spark):
    from tessella.operators.numbering import numbered

    df = spark.createDataFrame([(i * 7 % 100, str(i)) for i in range(100)], "k int, v string").repartition(9)
    got = {r.k: r.n for r in numbered(df, ["k"], "n", 5, partitions=7).collect()}
    assert got == {i: i + 5 for i in range(100)}
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def test_shared_tables(spark, monkeypatch):
    from tessella import tables

    t = tables.materialize(spark.range(5))
    assert t.count() == 5 and t._shared_folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    tables.remove(t)
    with pytest.raises(Exception):
        t.count()

    class Cluster:
        """A session on a cluster without a shared folder."""

        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Cluster)


def test_spread_over_cores(spark, tmp_path):
    from tessella import tables

    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(cores).write.parquet(str(tmp_path / "many"))
    parts = lambda df: df.rdd.getNumPartitions()
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
    assert parts(tables.spread(one)) == cores and tables.spread(one).count() == 100
    assert tables.spread(many) is many
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        assert tables.spread(one) is one, "its splits are enough"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
