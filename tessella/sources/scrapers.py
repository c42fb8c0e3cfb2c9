"""Scrapers: what is asked of a service, what of it is kept, and where the next run begins.

A service is a function `call(what, **arguments)` that returns what its API answers
(decoded JSON, or bytes of a file); it is the only thing here that knows a network, and is registered by source in
`SERVICES`.  Everything else works on plain rows and lands JSON lines in the raw folder, where the readers of `raw`
and the streams begin.  Rows are written as they come, so a run that stops goes on where it was.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from ..functions.documents import adf_text

Call = Callable[..., dict]

#: Makers of a source's service from its settings.
SERVICES: dict[str, Callable[[dict], Call]] = {}

# What chat messages are left out, and files without text of their own (links and films).
DROPPED_SUBTYPES = ("channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name")
LINKED_FILES = ("gdoc", "gsheet", "gpres", "gform", "gslides", "gdraw")
FILMS = ("mp4", "mov", "webm", "avi", "mkv", "flv")
# What drive files are read, as text of their own or as an export.
DRIVE_EXPORTS = {"application/vnd.google-apps.document": ("text/plain", "Google Doc"), "application/vnd.google-apps.spreadsheet": ("text/csv", "Google Sheet"), "application/vnd.google-apps.presentation": ("text/plain", "Google Slides")}
DRIVE_TEXTS = {"text/plain": "text", "text/markdown": "markdown", "text/csv": "csv"}
LEAST_TEXT = 50


def at(x, *path, default=""):
    """A value deep in what a service answered, or the default where something on the way is missing or null."""
    for p in path:
        x = x.get(p) if isinstance(x, dict) else x[p] if isinstance(x, list) and isinstance(p, int) and p < len(x) else None
    return default if x is None else x


def pages(call: Call, what: str, items: str, cursor: tuple[str, ...] = ("next",), argument: str = "cursor", **arguments) -> Iterator[dict]:
    """Items of all pages: a page names the next one at `cursor`, which goes into `argument`; without it, it was the last."""
    token = None
    while True:
        page = call(what, **arguments, **({argument: token} if token else {}))
        yield from at(page, items, default=[])
        token = at(page, *cursor, default=None)
        if not token:
            return


def rows_of(path: Path) -> Iterator[dict]:
    """Rows that earlier runs wrote; a line that a stopped run left unfinished is skipped."""
    if path.exists():
        with open(path, encoding="utf-8") as f:
            for line in f:
                if line.endswith("\n") and line.strip():
                    yield json.loads(line)


class Lines:
    """JSON lines of one raw file, written as they come."""

    def __init__(self, path: Path, keep: bool = True):
        path.parent.mkdir(parents=True, exist_ok=True)
        unfinished = keep and path.exists() and path.stat().st_size and not path.read_bytes()[-1:] == b"\n"
        self.file, self.n = open(path, "a" if keep else "w", encoding="utf-8"), 0
        if unfinished:
            self.file.write("\n")

    def add(self, rows: Iterable[dict]) -> None:
        for r in rows:
            self.file.write(json.dumps(r, ensure_ascii=False) + "\n")
            self.n += 1
        self.file.flush()

    def __enter__(self) -> Lines:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def allowed(name: str, settings: dict) -> bool:
    """Whether the lists of names in the settings let a channel through: an empty list of allowed ones allows all."""
    return (not settings.get("channel_allowlist") or name in settings["channel_allowlist"]) and name not in settings.get("channel_denylist", ())


# --- Chat ------------------------------------------------------------------------------------------------------------


def chat_message(m: dict, channel: dict, is_reply: bool) -> dict:
    """The raw row of an API message; reaction_count and links are added by `scrape.message_records`."""
    files = [{k: f.get(k, 0 if k == "size" else "") for k in ("id", "name", "filetype", "mimetype", "size", "url_private_download")} for f in m.get("files", [])]
    row = {"channel_id": channel["id"], "channel_name": channel["name"], "user_id": m.get("user", ""), "is_reply": is_reply, "reply_count": m.get("reply_count", 0), "files": files}
    return row | {k: m.get(k, "") for k in ("ts", "thread_ts", "text", "subtype")} | {"reactions": [{"name": at(r, "name"), "count": at(r, "count", default=0)} for r in m.get("reactions", [])]}


def wanted_file(f: dict, folder: Path, most: int) -> bool:
    """Whether a file is fetched: not a link, a film, larger than `most` bytes, without an address, or there already."""
    skip = f.get("filetype") in LINKED_FILES + FILMS or (f.get("size") or 0) > most or not f.get("url_private_download")
    return not skip and not stored_name(f, folder).exists()


def stored_name(f: dict, folder: Path) -> Path:
    return folder / f"{f['id']}_{os.path.basename(f.get('name') or 'file')}"


def chat(call: Call, folder: Path, settings: dict) -> dict:
    """Users, channels, and of every channel the messages since its newest one, their replies, pins, bookmarks and files."""
    state = "response_metadata", "next_cursor"
    users = {u["id"]: {"name": at(u, "profile", "real_name") or at(u, "name"), "title": at(u, "profile", "title"), "department": at(u, "profile", "fields", "department"), "is_bot": bool(u.get("is_bot"))} for u in pages(call, "users.list", "members", state)}
    kinds = "public_channel,private_channel" if settings.get("include_private") else "public_channel"
    channels = [
        {"id": c["id"], "name": c["name"], "topic": at(c, "topic", "value"), "purpose": at(c, "purpose", "value"), "is_private": bool(c.get("is_private")), "num_members": at(c, "num_members", default=0)}
        for c in pages(call, "conversations.list", "channels", state, types=kinds, exclude_archived=True) if allowed(c["name"], settings)
    ]
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "users.json").write_text(json.dumps(users, ensure_ascii=False), encoding="utf-8")
    (folder / "channels.json").write_text(json.dumps(channels, ensure_ascii=False), encoding="utf-8")
    newest: dict[str, str] = {}
    for r in rows_of(folder / "messages.jsonl"):
        if r.get("ts") and float(r["ts"]) > float(newest.get(r["channel_id"], "-inf")):
            newest[r["channel_id"]] = r["ts"]
    seen_files = {r["file_id"] for r in rows_of(folder / "files.jsonl")}
    bots, most = settings.get("include_bots", False), settings.get("max_file_size", 10_000_000)
    said = lambda m: m.get("subtype", "") not in DROPPED_SUBTYPES and (bots or not m.get("bot_id") and m.get("subtype") != "bot_message")
    with Lines(folder / "messages.jsonl") as out, Lines(folder / "pins.jsonl", keep=False) as pins, Lines(folder / "bookmarks.jsonl", keep=False) as marks, Lines(folder / "files.jsonl") as files:
        for c in channels:
            own = {"channel_id": c["id"], "channel_name": c["name"]}
            pins.add(own | {"user_id": at(p, "message", "user"), "ts": at(p, "message", "ts"), "text": at(p, "message", "text"), "pinned_by": at(p, "created_by")} for p in at(call("pins.list", channel=c["id"]), "items", default=[]) if p.get("message"))
            marks.add(own | {k: at(b, k) for k in ("title", "link", "emoji", "created_by")} for b in at(call("bookmarks.list", channel_id=c["id"]), "bookmarks", default=[]))
            since = {"oldest": newest[c["id"]]} if c["id"] in newest else {}
            for m in pages(call, "conversations.history", "messages", state, channel=c["id"], **since):
                if not said(m):
                    continue
                replies = [r for r in pages(call, "conversations.replies", "messages", state, channel=c["id"], ts=m["ts"]) if r["ts"] != m["ts"] and said(r)] if m.get("reply_count") else []
                out.add([chat_message(m, c, False), *(chat_message(r, c, True) for r in replies)])
                for f in [f for x in [m, *replies] for f in x.get("files", [])] if settings.get("fetch_files") else ():
                    if f["id"] in seen_files or not wanted_file(f, folder / "files", most):
                        continue
                    path = stored_name(f, folder / "files")
                    path.parent.mkdir(parents=True, exist_ok=True)
                    path.write_bytes(call("file", url=f["url_private_download"]))
                    seen_files.add(f["id"])
                    files.add([own | {"user_id": m.get("user", ""), "ts": m["ts"], "file_id": f["id"], "file_name": f.get("name", ""), "file_type": f.get("filetype", ""), "mime_type": f.get("mimetype", ""), "size": f.get("size", 0), "local_path": str(path)}])
    return {"users": len(users), "channels": len(channels), "messages": out.n, "pins": pins.n, "bookmarks": marks.n, "files": files.n}


# --- Wiki and tickets ------------------------------------------------------------------------------------------------


def wiki_pages(call: Call, settings: dict, to_text: Callable[[str], str]) -> Iterator[dict]:
    """Pages of the spaces named, else of all that are no person's own, with enough text."""
    spaces = settings.get("spaces") or [s["key"] for s in pages(call, "spaces", "results") if not s["key"].startswith("~")]
    for space in spaces:
        for p in pages(call, "pages", "results", space=space, expand="body.storage,ancestors"):
            text = to_text(at(p, "body", "storage", "value"))
            if len(text) >= LEAST_TEXT:
                yield {"type": "confluence", "title": at(p, "title"), "content": text, "space": space, "ancestors": " > ".join(at(a, "title") for a in at(p, "ancestors", default=[]))}


def rich(x) -> str:
    """Text of a field that is a document tree or plain."""
    return adf_text(json.dumps(x)) if isinstance(x, dict) else str(x or "").strip()


def ticket(issue: dict) -> dict:
    """Description, status, type and all comments of an issue as one text."""
    f = issue.get("fields", {})
    said = [f"- {at(c, 'author', 'displayName', default='Unknown')}: {body}" for c in at(f, "comment", "comments", default=[]) if (body := rich(c.get("body")))]
    parts = [rich(f.get("description")), f"Status: {at(f, 'status', 'name')}", f"Type: {at(f, 'issuetype', 'name')}", *(["\nComments:", *said] if at(f, "comment", "comments", default=[]) else [])]
    return {"type": "jira", "key": at(issue, "key"), "summary": at(f, "summary"), "content": "\n".join(p for p in parts if p), "project": at(f, "project", "name")}


def tickets(call: Call, settings: dict) -> Iterator[dict]:
    """Issues of the projects named, else those updated within two years, with enough text."""
    named = " OR ".join(f"project = {p}" for p in settings.get("projects") or ())
    query = f"({named}) ORDER BY updated DESC" if named else "updated >= -730d ORDER BY updated DESC"
    for issue in pages(call, "issues", "issues", ("nextPageToken",), "nextPageToken", jql=query):
        if len((row := ticket(issue))["content"]) >= LEAST_TEXT:
            yield row


def html_text(html: str) -> str:
    """`functions.text.html_to_text` for a single value."""
    import re

    from ..functions.text import HTML_STEPS

    for pattern, to in HTML_STEPS:
        html = re.sub(pattern, to, html)
    return html.strip()


def atlassian(call: Call, folder: Path, settings: dict) -> dict:
    with Lines(folder / "atlassian.jsonl", keep=False) as out:
        out.add(wiki_pages(call, settings, html_text))
        n = out.n
        out.add(tickets(call, settings))
    return {"pages": n, "tickets": out.n - n}


# --- Drive -----------------------------------------------------------------------------------------------------------


def folder_path(call: Call, folder_id: str | None, known: dict[str, tuple[str, str | None]], depth: int = 5) -> str:
    """Names from the root down, of at most `depth` folders; every folder is asked for once."""
    names: list[str] = []
    while folder_id and len(names) < depth:
        if folder_id not in known:
            f = call("folder", id=folder_id)
            known[folder_id] = at(f, "name"), at(f, "parents", 0, default=None)
        name, folder_id = known[folder_id]
        names.append(name)
    return " > ".join(reversed(names))


def drive(call: Call, folder: Path, settings: dict) -> dict:
    """Files that earlier runs don't have: documents as an export, texts of up to 1 MB as they are, with enough text."""
    have, known = {r["file_id"] for r in rows_of(folder / "gdrive.jsonl")}, {}
    with Lines(folder / "gdrive.jsonl") as out:
        for f in pages(call, "files", "files", ("nextPageToken",), "pageToken", trashed=False):
            kind = at(f, "mimeType")
            if f["id"] in have or kind not in DRIVE_EXPORTS and (kind not in DRIVE_TEXTS or int(at(f, "size", default=0)) > 1_000_000):
                continue
            to, label = DRIVE_EXPORTS.get(kind, (None, DRIVE_TEXTS.get(kind)))
            data = call("export", id=f["id"], mimeType=to) if to else call("media", id=f["id"])
            text = data.decode("utf-8", "replace") if isinstance(data, bytes) else str(data)
            if len(text.strip()) >= LEAST_TEXT:
                out.add([{"file_id": f["id"], "name": at(f, "name"), "owner": at(f, "owners", 0, "displayName"), "content": text, "mime_type": kind, "file_type": label, "path": folder_path(call, at(f, "parents", 0, default=None), known)}])
    return {"files": out.n}


# --- Repositories and pull requests ----------------------------------------------------------------------------------


def repositories(patterns: list[str]) -> list[str]:
    """Checked-out repositories that the patterns name, each once, in the order of the patterns; what matches nothing stays
    as it is written."""
    found = (m for p in patterns for m in (sorted(glob.glob(os.path.expanduser(p))) or [p]))
    return list(dict.fromkeys(str(Path(m).resolve()) for m in found if not os.path.exists(m) or os.path.isdir(os.path.join(m, ".git"))))


def pull_request(pr: dict, repo: str, comments: Iterable[dict], activity: Iterable[dict]) -> dict:
    approvals = dict.fromkeys(n for a in activity if (n := at(a, "approval", "user", "display_name")))
    said = [{"author": at(c, "user", "display_name"), "content": at(c, "content", "raw"), "created_on": at(c, "created_on"), "path": at(c, "inline", "path", default=None), "line": at(c, "inline", "to", default=None)} for c in comments if at(c, "content", "raw")]
    plain = {k: at(pr, k) for k in ("title", "description", "state", "created_on", "updated_on")}
    return {"repo": repo, "pr_id": pr["id"], **plain, "author": at(pr, "author", "display_name"), "source_branch": at(pr, "source", "branch", "name"), "target_branch": at(pr, "destination", "branch", "name"), "comments": said, "approvals": list(approvals)}


def bitbucket(call: Call, folder: Path, settings: dict) -> dict:
    """Pull requests updated since the date in the settings (texts compared) that earlier runs don't have."""
    have, since = {(r["repo"], r["pr_id"]) for r in rows_of(folder / "bitbucket.jsonl")}, settings.get("since", "")
    repos = settings.get("repos") or [r["slug"] for r in pages(call, "repositories", "values")]
    with Lines(folder / "bitbucket.jsonl") as out:
        for repo in repos:
            for pr in pages(call, "pullrequests", "values", repo=repo):
                if (repo, pr["id"]) not in have and at(pr, "updated_on") >= since:
                    out.add([pull_request(pr, repo, pages(call, "comments", "values", repo=repo, id=pr["id"]), pages(call, "activity", "values", repo=repo, id=pr["id"]))])
    return {"pull_requests": out.n}


SCRAPERS: dict[str, Callable[[Call, Path, dict], dict]] = {"slack": chat, "atlassian": atlassian, "gdrive": drive, "bitbucket": bitbucket}


def run(source: str, raw_folder: str, settings: dict, call: Call | None = None) -> dict:
    """Scrapes a source into the raw folder and returns what was counted."""
    if source not in SCRAPERS:
        raise ValueError(f"no scraper for {source!r}: {', '.join(sorted(SCRAPERS))}")
    if call is None:
        if source not in SERVICES:
            raise ValueError(f"no service is registered for {source!r}: put its maker into SERVICES")
        call = SERVICES[source](settings)
    return SCRAPERS[source](call, Path(raw_folder), settings)
