"""Command line: `tessella TERM` searches; ingest, query, stats, inspect, eval and records work on an index."""

from __future__ import annotations

import argparse
import json
import sys

PIPELINE = ("scrape", "ingest", "query", "stats", "eval", "inspect", "export")


def is_pipeline(argv: list[str]) -> bool:
    """Whether the first word that is no option names a pipeline command; after `--` nothing does."""
    skip = False
    for a in argv:
        if a == "--":
            return False
        if skip:
            skip = False
        elif a in ("--config", "-c"):
            skip = True
        elif not a.startswith("-"):
            return a in PIPELINE
    return False


def search_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tessella", description="Search an index.")
    p.add_argument("term")
    p.add_argument("-n", type=int, default=10, help="results")
    p.add_argument("-s", "--source")
    p.add_argument("-m", "--mode", choices=("grep", "semantic", "hybrid"), default="hybrid")
    p.add_argument("-f", "--filter", action="append", default=[], help="key=value (equal, in any case) or one JSON object")
    p.add_argument("--after")
    p.add_argument("--before")
    p.add_argument("-c", "--context", type=int)
    for flag in ("full", "json", "scores", "metadata"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--server", help="address of a running server")
    p.add_argument("--config")
    return p


def pipeline_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tessella")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scrape")
    s.add_argument("--source", required=True)
    s = sub.add_parser("ingest")
    s.add_argument("--force", action="store_true")
    s.add_argument("--source", help="index this source alone: replaces the whole index")
    s = sub.add_parser("query")
    s.add_argument("text", nargs="?", help="without it, questions are read line by line")
    s.add_argument("--source")
    sub.add_parser("stats")
    s = sub.add_parser("eval")
    s.add_argument("--output", help="file for a report of every question")
    s.add_argument("--cases", type=int, default=50)
    s = sub.add_parser("export", help="the record collection as JSON lines")
    s.add_argument("path")
    s = sub.add_parser("inspect")
    s.add_argument("what", choices=("raw", "docs", "sample", "grep"))
    s.add_argument("term", nargs="?", default="")
    s.add_argument("-n", type=int, default=5)
    return p


def search_remote(a: argparse.Namespace) -> dict:
    from urllib.parse import urlencode
    from urllib.request import urlopen

    params = {"q": a.term, "mode": a.mode, "n": a.n, "context": a.context if a.context is not None else 0 if a.json else 200, "full": int(a.full), "scores": int(a.scores), "metadata": int(a.metadata)}
    params |= {k: v for k, v in (("source", a.source), ("after", a.after), ("before", a.before)) if v}
    if a.filter:
        from .functions.filters import parse_filters

        params["filter"] = json.dumps(parse_filters(a.filter))
    with urlopen(f"{a.server.rstrip('/')}/search?{urlencode(params)}", timeout=180 if a.server.startswith("https") else 30) as r:
        return json.load(r)


def show(result: dict, as_json: bool) -> str:
    if as_json:
        return json.dumps(result, ensure_ascii=False)
    lines = [f"{result['total_matches']} matches"] if "total_matches" in result else []
    for r in result["results"]:
        lines += [f"{r['rank']}. [{r['source']}] {r['title']}  ({r['id']})", f"   {r.get('snippet') or r.get('content', '')}"]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    from . import config, session
    from .index import Index
    from .server import run_search

    config.load_env()
    if not is_pipeline(argv):
        a = search_parser().parse_args([x for x in argv if x != "--"])
        if a.server:
            print(show(search_remote(a), a.json))
            return 0
        c = config.load(a.config)
        spark = session.build()
        index, docs = Index(spark, c.data.index_dir), None
        if a.mode == "grep" and not index.exists():
            from .sources.normalize import normalize_all

            docs = normalize_all(spark, c.data.raw_dir)
        context = a.context if a.context is not None else 0 if a.json else 200
        print(show(run_search(index, a.term, a.mode, a.n, source=a.source, filters=a.filter, after=a.after, before=a.before, context=context, full=a.full, scores=a.scores, metadata=a.metadata, docs=docs), a.json))
        return 0
    a = pipeline_parser().parse_args(argv)
    c = config.load(a.config)
    if a.command == "scrape":
        from .sources import scrapers

        try:
            print(json.dumps(scrapers.run(a.source, c.data.raw_dir, c.scrape.get(a.source, {}))))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    spark = session.build()
    index = Index(spark, c.data.index_dir, max_chunk_tokens=c.ingest.max_chunk_tokens, chunk_overlap_tokens=c.ingest.chunk_overlap_tokens, dedup_threshold=c.retrieval.dedup_threshold)
    if a.command == "ingest":
        from .sources.normalize import normalize_all

        docs = normalize_all(spark, c.data.raw_dir)
        print(json.dumps(index.ingest(docs.where(docs.source == a.source) if a.source else docs, a.force)))
    elif a.command == "query":
        for text in [a.text] if a.text else iter(lambda: input("? "), ""):
            for r in index.query(text, source=a.source).sources:
                print(f"{r['rank']}. [{r['source']}] {r['title']} ({r['id']})")
    elif a.command == "stats":
        from .operators.inspect import duplicates, lengths, source_counts

        for t in (source_counts(index.chunks()), lengths(index.chunks()), duplicates(index.chunks())):
            t.show(100, False)
    elif a.command == "eval":
        index.evaluate(a.output, a.cases).show()
    elif a.command == "export":
        index.export_records(a.path)
    else:
        from .operators import inspect as I
        from .sources.normalize import normalize_all

        if a.what == "raw":
            I.raw_files(spark.read.text(f"{c.data.raw_dir}/*.jsonl").select("value", "_metadata")).show(100, False)
        elif a.what == "docs":
            I.docs_and_chunks(normalize_all(spark, c.data.raw_dir), index.chunks()).show(100, False)
        elif a.what == "sample":
            I.sample(index.chunks(), a.n).show(a.n, 200)
        else:
            index.grep(a.term, a.n).show(a.n, 200)
    return 0


if __name__ == "__main__":
    sys.exit(main())
