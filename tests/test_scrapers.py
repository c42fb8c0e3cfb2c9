import json

import pytest

from tessella.operators.rerank import ASKED, templated
from tessella.sources import scrapers as S

LONG = "enough words for a page, and then some more of them, so that it counts"


class Service:
    """A fake service: answers by what is asked, page by page, and remembers the calls."""

    def __init__(self, answers):
        self.answers, self.calls = answers, []

    def __call__(self, what, **a):
        self.calls.append((what, a))
        x = self.answers[what]
        x = x(a) if callable(x) else x
        return x


def paged(items, key, argument="cursor", name=("next",), size=2):
    def page(a):
        at = int(a.get(argument) or 0)
        out = {key: items[at:at + size]}
        if at + size < len(items):
            deep = str(at + size)
            for n in reversed(name):
                deep = {n: deep}
            out |= deep
        return out
    return page


def lines(path):
    return [json.loads(x) for x in path.read_text().splitlines()]


def chat_service(messages, replies):
    cursor = ("response_metadata", "next_cursor")
    return Service({
        "users.list": paged([{"id": "U1", "name": "n", "profile": {"real_name": "R", "title": "T"}}, {"id": "B", "is_bot": True}, {"id": "U3"}], "members", name=cursor),
        "conversations.list": paged([{"id": f"C{k}", "name": f"c{k}", "topic": {"value": "t"}} for k in range(4)], "channels", name=cursor),
        "pins.list": {"items": [{"message": {"user": "U1", "ts": "1", "text": "pinned"}, "created_by": "U2"}, {}]}, "bookmarks.list": {"bookmarks": [{"title": "t", "link": "l"}]},
        "conversations.history": lambda a: paged([m for m in messages if float(m["ts"]) > float(a.get("oldest", 0))] if a["channel"] == "C1" else [], "messages", name=cursor)(a),
        "conversations.replies": lambda a: paged(replies, "messages", name=cursor)(a), "file": lambda a: b"data",
    })


def test_chat(tmp_path):
    messages = [{"ts": "1", "text": "root", "user": "U1", "reply_count": 3, "files": [{"id": "f", "name": "../a.txt", "filetype": "text", "size": 4, "url_private_download": "u"}, {"id": "g", "filetype": "gdoc", "url_private_download": "u"}]}, {"ts": "2", "subtype": "channel_join"}, {"ts": "3", "text": "bot", "bot_id": "B"}]
    replies = [{"ts": "1", "text": "root"}, {"ts": "1.5", "text": "reply", "thread_ts": "1"}, {"ts": "1.6", "text": "r2", "thread_ts": "1"}]
    call, settings = chat_service(messages, replies), {"channel_denylist": ["c0"], "fetch_files": True}
    assert S.run("slack", str(tmp_path), settings, call) == {"users": 3, "channels": 3, "messages": 3, "pins": 3, "bookmarks": 3, "files": 1}
    rows = lines(tmp_path / "messages.jsonl")
    assert [(r["ts"], r["is_reply"]) for r in rows] == [("1", False), ("1.5", True), ("1.6", True)] and rows[0]["channel_name"] == "c1"
    assert json.loads((tmp_path / "users.json").read_text())["U1"] == {"name": "R", "title": "T", "department": "", "is_bot": False}
    assert (tmp_path / "files" / "f_a.txt").read_bytes() == b"data"
    # The next run begins after the newest message, and appends.
    messages.append({"ts": "9", "text": "new"})
    with open(tmp_path / "messages.jsonl", "a") as f:
        f.write('{"unfinished')
    assert S.run("slack", str(tmp_path), settings, call)["messages"] == 1
    asked = [a for w, a in call.calls if w == "conversations.history" and a["channel"] == "C1"]
    assert "oldest" not in asked[0] and asked[-1]["oldest"] == "1.6"
    assert S.run("slack", str(tmp_path / "only"), {"channel_allowlist": ["c2"], "include_bots": True}, call)["channels"] == 1


def test_wiki_and_tickets(tmp_path):
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": LONG}]}]}
    call = Service({
        "spaces": {"results": [{"key": "A"}, {"key": "~own"}]},
        "pages": paged([{"title": "P", "body": {"storage": {"value": f"<p>{LONG}</p>"}}, "ancestors": [{"title": "x"}, {"title": "y"}]}, {"title": "short", "body": {"storage": {"value": "<p>no</p>"}}}, {"title": "none"}], "results"),
        "issues": paged([{"key": "K-1", "fields": {"summary": "s", "description": tree, "status": {"name": "Open"}, "issuetype": {"name": "Bug"}, "project": {"name": "K"}, "comment": {"comments": [{"author": {"displayName": "Ann"}, "body": "done"}, {"author": None, "body": ""}]}}}, {"key": "K-2", "fields": {"description": None}}, {"key": "K-3", "fields": {"description": LONG}}], "issues", "nextPageToken", ("nextPageToken",)),
    })
    assert S.run("atlassian", str(tmp_path), {}, call) == {"pages": 1, "tickets": 2}
    page, first, second = lines(tmp_path / "atlassian.jsonl")
    assert page == {"type": "confluence", "title": "P", "content": LONG, "space": "A", "ancestors": "x > y"}
    assert first["content"] == f"{LONG}\nStatus: Open\nType: Bug\n\nComments:\n- Ann: done" and second["key"] == "K-3"
    assert [a["space"] for w, a in call.calls if w == "pages"] == ["A", "A"]
    assert "project = X OR project = Y" in next(a["jql"] for w, a in [*Service({}).calls, *_asked({"projects": ["X", "Y"]}, call)] if w == "issues")


def _asked(settings, call):
    call.calls.clear()
    list(S.tickets(call, settings))
    return call.calls


def test_drive(tmp_path):
    doc, text = "application/vnd.google-apps.document", "text/plain"
    files = [{"id": "1", "name": "a", "mimeType": doc, "parents": ["f3"], "owners": [{"displayName": "O"}]}, {"id": "2", "name": "big", "mimeType": text, "size": "2000000"}, {"id": "3", "name": "t", "mimeType": text, "size": "9", "parents": ["f2"]}, {"id": "4", "mimeType": "image/png"}, {"id": "5", "mimeType": doc, "name": "short"}]
    call = Service({"files": paged(files, "files", "pageToken", ("nextPageToken",)), "folder": lambda a: {"name": a["id"], "parents": [f"f{int(a['id'][1:]) - 1}"]}, "export": lambda a: LONG if a["id"] == "1" else "no", "media": lambda a: LONG.encode()})
    assert S.run("gdrive", str(tmp_path), {}, call) == {"files": 2}
    a, b = lines(tmp_path / "gdrive.jsonl")
    assert (a["path"], a["file_type"], a["owner"]) == ("f-1 > f0 > f1 > f2 > f3", "Google Doc", "O") and b["path"] == "f-2 > f-1 > f0 > f1 > f2"
    assert sum(w == "folder" for w, _ in call.calls) == 6, "every folder is asked for once"
    assert S.run("gdrive", str(tmp_path), {}, call) == {"files": 0}


def test_pull_requests(tmp_path):
    prs = [{"id": k, "title": f"t{k}", "updated_on": f"2026-0{k}-01", "author": {"display_name": "A"}, "source": {"branch": {"name": "s"}}} for k in (1, 2, 3)]
    call = Service({
        "repositories": paged([{"slug": "r"}], "values"), "pullrequests": paged(prs, "values"),
        "comments": paged([{"content": {"raw": "hi"}, "user": {"display_name": "B"}, "inline": {"path": "p", "to": 3}}, {"content": {"raw": ""}}, {"content": {"raw": "yo"}}], "values"),
        "activity": paged([{"approval": {"user": {"display_name": "Z"}}}, {"update": 1}, {"approval": {"user": {"display_name": "Y"}}}, {"approval": {"user": {"display_name": "Z"}}}], "values"),
    })
    assert S.run("bitbucket", str(tmp_path), {"since": "2026-02-01"}, call) == {"pull_requests": 2}
    row = lines(tmp_path / "bitbucket.jsonl")[0]
    assert row["approvals"] == ["Z", "Y"] and [c["content"] for c in row["comments"]] == ["hi", "yo"] and row["comments"][0]["line"] == 3 and row["comments"][1]["path"] is None
    assert S.run("bitbucket", str(tmp_path), {}, call) == {"pull_requests": 1}


def test_repositories(tmp_path):
    for n in ("b", "a", "plain"):
        (tmp_path / n / (".git" if n != "plain" else "x")).mkdir(parents=True)
    got = S.repositories([str(tmp_path / "b"), str(tmp_path / "*"), str(tmp_path / "none")])
    assert got == [str((tmp_path / n).resolve()) for n in ("b", "a", "none")]


def test_unknown_sources(tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        S.run("odd", str(tmp_path), {})
    with pytest.raises(ValueError):
        S.run("slack", str(tmp_path), {})
    monkeypatch.setitem(S.SERVICES, "gdrive", lambda settings: Service({"files": {"files": []}}))
    assert S.run("gdrive", str(tmp_path), {}) == {"files": 0}


def test_reranking_form():
    seen = []
    templated(lambda pairs: seen.extend(pairs) or [1.0], "do")([("what {document}", None)])
    assert seen[0][0].endswith("<Instruct>: do\n<Query>: what {document}\n") and seen[0][1].startswith("<Document>: <|im_end|>") and ASKED.startswith("<|im_start|>system")
