import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.schema import RAW
from tessella.sources import extract, normalize, raw, scrape

LONG = "a text that is long enough to stay"


@pytest.fixture
def folder(tmp_path):
    def put(name, *records):
        (tmp_path / name).write_text("\n\n".join(json.dumps(r) for r in records) + "\n")
    (tmp_path / "users.json").write_text(json.dumps([{"id": "U1", "name": "Ann", "title": "QA"}, {"name": "no id"}, {"id": "U1", "name": "Anna", "title": "QA"}, {"id": "U2", "name": "Bo"}]))
    (tmp_path / "channels.json").write_text(json.dumps({"C1": {"name": "general", "topic": "all"}}))
    put("messages.jsonl",
        {"channel_id": "C1", "channel_name": "general", "user_id": "U1", "ts": "2.0", "thread_ts": "1.0", "text": "second <@U2>"},
        {"channel_id": "C1", "channel_name": "general", "user_id": "U2", "ts": "1.0", "text": "first *line* of it", "reply_count": 1, "reaction_count": 2},
        {"channel_id": "C1", "channel_name": "general", "user_id": "U9", "ts": "5.5", "text": LONG, "thread_ts": ""},
        {"channel_id": "C1", "channel_name": "general", "user_id": "U9", "ts": "6", "text": LONG, "subtype": "channel_join"},
        {"channel_id": "C1", "channel_name": "general", "user_id": "U9", "ts": "7", "text": "short"},
        {"channel_id": "C1", "ts": "8", "thread_ts": "8", "text": None})
    put("atlassian.jsonl", {"type": "jira", "key": "AB-1", "summary": "It breaks", "content": LONG, "project": "AB"}, {"type": "confluence", "title": "T" * 130, "content": LONG, "space": "S"}, {"title": "x", "content": "short"})
    put("gdrive.jsonl", {"file_id": "f1", "name": "Doc", "content": f"  {LONG} ", "file_type": "Google Doc", "path": "a/b"}, {"file_id": "f2", "name": "S", "content": LONG, "file_type": "Google Sheet"}, {"name": "n", "content": LONG, "mime_type": "x/spreadsheet"})
    put("git.jsonl", {"repo": "r", "hash": "h1", "author": "a", "date": "2026-05-10", "subject": "s", "body": "b", "pr_number": 3, "branch": "x", "files_changed": [{"status": "M", "path": "p"}], "diff": "D", "diff_stat": "S"}, {"repo": "r", "hash": "h2", "author": "a", "date": "d", "subject": "s2", "diff_stat": "S"})
    put("files_extracted.jsonl", {"file_id": "F1", "content": LONG, "channel_name": "c"})
    put("bookmarks.jsonl", {"title": "t", "link": "http://l", "channel_name": "c"}, {"title": "", "link": "http://l"})
    put("pins.jsonl", {"channel_name": "c", "ts": "1", "text": LONG + " <@U2>"})
    put("code.jsonl", {"repo": "r", "path": "a.py", "language": "python", "content": "x = 1\n" * 30, "size_bytes": 180}, {"repo": "r", "path": "b.py", "content": "short"})
    put("bitbucket.jsonl", {"repo": "r", "pr_id": 4, "title": "t", "description": " why it is so ", "author": "a", "state": "MERGED", "comments": [{"author": "b", "content": "looks good", "path": "p"}, {"author": "c", "content": ""}], "approvals": ["b", "c", "b"]})
    return str(tmp_path)


def test_all_sources(spark, folder):
    docs = {r.id: r for r in normalize.normalize_all(spark, folder).collect()}
    m = lambda r: {k: v.s for k, v in r.metadata.items()}
    t = docs["slack:general:1.0"]
    assert t.content == "Bo: first line of it\nAnna (QA): second @Bo" and t.title == "#general: first line of it"
    assert m(t) == {"channel_name": "general", "message_count": "2", "reaction_count": "2", "date": "1970-01-01", "channel_topic": "all"}
    assert docs["slack:general:5.5"].content == f"U9: {LONG}" and "channel_topic" not in docs["slack:general:5.5"].metadata
    assert not any(i.endswith((":6", ":7", ":8")) for i in docs if i.startswith("slack"))
    a = [r for r in docs.values() if r.source == "atlassian"]
    assert sorted(len(r.title) for r in a) == [15, 120] and {m(r)["space"] for r in a} == {"AB", "S"}
    assert docs["gdrive:f1"].content == LONG and m(docs["gdrive:f1"])["doc_type"] == "doc" and sum(r.source == "gdrive" for r in docs.values()) == 1
    g = docs["git:r:h1"]
    assert g.content == "s\nb\nAuthor: a\nDate: 2026-05-10\nPR: #3\nBranch: x\nFiles changed:\n  M p\nDiff:\nD" and g.title == "r PR#3: s" and g.metadata["files_count"].kind == "int"
    assert docs["git:r:h2"].content.endswith("Diff stat:\nS") and docs["git:r:h2"].title == "r: s2" and "branch" not in docs["git:r:h2"].metadata
    assert docs["code:r:a.py"].content.startswith("# r/a.py\n\nx = 1") and "code:r:b.py" not in docs
    b = docs["bitbucket:r:4"]
    assert b.content == "a: why it is so\nb on p: looks good" and m(b)["comment_count"] == "2" and m(b)["approvals"] == "b, c"
    assert docs["pin:c:1"].content.endswith("@Bo") and docs["file:F1"].title == "unknown"
    assert sum(r.source == "bookmark" for r in docs.values()) == 1


def test_many_users_are_joined(spark, folder, monkeypatch):
    few = sorted(tuple(map(str, r)) for r in normalize.normalize_all(spark, folder).collect())
    monkeypatch.setattr(normalize, "MAPPED_USERS", 0)
    assert sorted(tuple(map(str, r)) for r in normalize.normalize_all(spark, folder).collect()) == few


def test_missing_files_are_empty_and_bad_lines_fail(spark, tmp_path):
    assert normalize.normalize_all(spark, str(tmp_path)).count() == 0
    (tmp_path / "git.jsonl").write_text("{\n")
    with pytest.raises(Exception):
        raw.read_raw(spark, str(tmp_path), "git").collect()


def test_first_of_an_id_stays(spark):
    d = lambda *x: spark.createDataFrame(list(x), "id string, content string, src_ord bigint")
    got = normalize.union_documents([d(("a", "1", 5), ("a", "0", 2)), d(("a", "x", 0), ("b", "y", 0))]).collect()
    assert {r.id: r.content for r in got} == {"a": "0", "b": "y"}


def test_threads_by_channel(spark):
    rows = spark.createDataFrame([("C1", "x", "u", "1", "9", LONG, 0), ("C2", "y", "u", "2", "9", LONG, 1)], "channel_id string, channel_name string, user_id string, ts string, thread_ts string, text string, src_ord bigint").select("*", F.lit(None).cast("string").alias("subtype"), F.lit(0).cast("bigint").alias("reply_count"), F.lit(0).cast("bigint").alias("reaction_count"))
    users = spark.createDataFrame([], "id string, name string, title string")
    assert normalize.messages(rows, users).count() == 1 and normalize.messages(rows, users, by_channel=True).count() == 2
    assert normalize.messages(rows.limit(0), users).count() == 0


def test_scraping_helpers(spark):
    msgs = spark.createDataFrame([("C", "c", "U1", "1.5", "hi <@U2> <https://l|x>", [("ok", 2), ("no", None)], [("f", "n", "t", "m", 1, "u")]), ("C", "c", "U3", "10", None, None, [("f", "later", "t", "m", 1, "u")])], "channel_id string, channel_name string, user_id string, ts string, text string, reactions array<struct<name:string,count:bigint>>, files array<struct<id:string,name:string,filetype:string,mimetype:string,size:bigint,url_private_download:string>>")
    users = spark.createDataFrame([("U1",)], "id string")
    assert {r.id for r in scrape.unknown_users(msgs, users).collect()} == {"U2", "U3"}
    assert scrape.high_water(msgs).first().last_ts == "10"
    assert [(r.file_id, r.file_name) for r in scrape.attached_files(msgs).collect()] == [("f", "n")]
    r = scrape.message_records(msgs).orderBy("ts").collect()
    assert {x.ts: (x.reaction_count, x.links) for x in r} == {"1.5": (2, ["https://l"]), "10": (0, [])}
    paths = scrape.folder_paths(spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("d", "D", "gone")], "id string, name string, parent string"))
    assert {r.id: r.path for r in paths.collect()} == {"a": "A", "b": "A > B", "c": "A > B > C", "d": "D"}
    log = spark.createDataFrame([("Merged in x (pull request #7)", "d" * 60_000, [("M", "a.lock")])], "subject string, diff string, files_changed array<struct<status:string,path:string>>")
    c = scrape.commits(log, [r"\.lock$"]).first()
    assert (c.pr_number, c.branch, c.diff, c.files_changed) == (7, "x", None, [])


def test_code_files(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n" * 40, "vendor/b.py": "x = 1\n" * 40, "c.txt": "t" * 200, "d.go": "short", "bin.py": "\x01" * 300, "e.min.js": "x" * 200, "src/__init__.py": "x = 1\n" * 40, "openapi/f.py": "x = 1\n" * 40, "static/swagger-x.js": "x" * 200}.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "latin.py").write_bytes(b"# \xe9\n" * 60)
    got = scrape.code_files(spark, str(tmp_path), "r").collect()
    assert [(r.path, r.language, r.size_bytes) for r in got] == [("src/a.py", "python", 240)]


def test_extraction(spark, tmp_path):
    def docx(text):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
        return b.getvalue()
    (tmp_path / "a.txt").write_text(LONG * 3)
    (tmp_path / "b.docx").write_bytes(docx(LONG * 3))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "short.txt").write_text("x")
    (tmp_path / "c.png").write_bytes(b"\x89PNG")
    got = extract.extract_texts(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {r.extraction_method: r.content for r in got} == {"txt": LONG * 3, "docx": LONG * 3}


def test_registered_extractors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extract, "EXTRACTORS", dict(extract.EXTRACTORS))
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.xyz").write_bytes(b"?")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.ending: r.n for r in extract.unread(files).collect()} == {"pdf": 1, "xyz": 1}
    extract.register(lambda data: "text of the file " * 9, ".pdf")
    assert [r.extraction_method for r in extract.extract_texts(files).collect()] == ["pdf"]


def test_schemas_parse(spark):
    for s in RAW.values():
        assert spark.createDataFrame([], s).count() == 0
