"""Credentials in source code, configuration and prose: find them and redact their values.

Lines that name a credential (or show a vendor's token format, an address with
a password, a private key) give candidate values.  A candidate is scored by a
logistic regression on the value's likelihood under a character Markov model of
the corpus's ordinary words, on the identifiers around it and on the path of
the file.  The Markov model counts the characters of all contents; the
regression is fitted on a bounded sample (`SAMPLE_ROWS` different contents of
`SAMPLE_CHARS` characters together, the least by hash), labelled by patterns
that are sure of themselves; scores of rows held out in turn calibrate it
(Platt), and scores of `THRESHOLD` or more count.

A private key is taken by its header and the lines of key material below it, up
to its own END line or, in a truncated block, to where lines stop looking like
key material; each line's material is a span of its own.

Null and empty contents have no credentials; repeated rows count once; line
numbers count from 1 and lines end at LF.  Without a sample of both kinds the
pattern labels decide alone.
"""

from __future__ import annotations

import base64
import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread

SAMPLE_ROWS, SAMPLE_CHARS, THRESHOLD = 4000, 40_000_000, 0.5
MASK = "[REDACTED]"

# Words that make a key a credential.
_BEFORE_KEY = frozenset("api access signing private secret encryption auth account service master shared".split())
# Words that name credentials.
_NAMES = rf"pass(?:word|wd|phrase|code)?(?!port|age|ing|ed\b|es\b|ive|enger)|pwd|\bpw|secret|token|(?:{'|'.join(sorted(_BEFORE_KEY))})[_-]?key|credentials?|client[_-]?secret"
# Token formats that vendors publish.
_VENDOR = re.compile(
    r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[\w-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,}|AIza[\w-]{30,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,})(?![A-Za-z0-9_-])"
)
# Every line that can hold a candidate has one of these, in lower case.
_HINTS = (
    "pass", "pwd", "pw:", "pw ", "pw=", "secret", "token", "key", "credential", "bearer", "basic ", "://", " -u", "--user", "auth", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_",
    "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "eyj", "aiza", "npm_", "hf_", "sg.",
)


def _hinted(content: str) -> list[int]:
    """Starts of the lines that have a hint."""
    low = content.lower()
    if len(low) != len(content):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in content)
    starts = set()
    for hint in _HINTS:
        i = low.find(hint)
        while i >= 0:
            starts.add(low.rfind("\n", 0, i) + 1)
            i = low.find("\n", i)
            if i >= 0:
                i = low.find(hint, i)
    return sorted(starts)


_ASSIGN = re.compile(rf"(?i)(?P<key>[\w.-]*(?:{_NAMES})[\w-]*)[\"'\]]{{0,2}}\s*(?P<op>:=|=>|==|=|:|>)\s*(?=\S)")
_SAID = re.compile(rf"(?i)(?P<key>[\w-]*(?:{_NAMES}))[\"'`]?(?:\s+(?:is|was|to|now|=))?\s+(?P<val>\S+)")
_NAMED = re.compile(rf"(?i){_NAMES}")
# The characters that the key of either may consist of.
_ASSIGN_RUN, _SAID_RUN = re.compile(r"[\w.-]+"), re.compile(r"[\w-]+")


def _keyed(pattern: re.Pattern, run: re.Pattern, line: str):
    """`pattern.finditer(line)` for a pattern that begins with any characters of `run` and then a name of a credential.

    Tried once for each run that has a name: where it fails at a run's beginning it fails within it, so the search does not
    try every character of a line."""
    if not _NAMED.search(line):
        return
    done = 0
    for r in run.finditer(line):
        if r.end() > done and _NAMED.search(r[0]) and (m := pattern.match(line, max(done, r.start()))):
            yield m
            done = m.end()


_ADDRESS = re.compile(r"://(?P<key>[^\s/:@\"']*):(?P<val>[^\s/\"']+)@(?=[\w\[.-])")
_LOGIN = re.compile(r"\s(?:-u|--user)[ =]+['\"]?(?P<key>[\w.$@{}-]+):['\"]?(?P<val>[^\s'\"]+)")
_PAIR = re.compile(r"(?i)auth\w*\s*[=(:]\s*\(?\s*[\"'](?P<key>[^\"'\s]*)[\"']\s*,\s*[\"'](?P<val>[^\"']+)[\"']")
_SHORT_FLAG = re.compile(r"\s(?:-u|--user[= ])\s?(?P<key>\S+)\s(?:[^|;]*\s)?-p\s?['\"]?(?P<val>[^\s'\"]{4,})")
_BEARER = re.compile(r"(?i)\b(?P<key>bearer|basic)\s+(?P<val>[^\s'\"`<>]{6,})")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# Between BEGIN and body: blank lines and headers ("Proc-Type: 4,ENCRYPTED", "Version: ..."), quoted or in a diff like the body.
_KEY_HEADER = re.compile(r"^[\s+\-\"'>#*/\\n]*(?:[A-Z][A-Za-z0-9-]*:(?:\s.*)?)?$")
_AROUND_BODY = " \t\r\"'`>#*,;+-.&|()"
_MATERIAL = re.compile(r"[A-Za-z0-9+/=]+")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_IN_LINE = re.compile(r"(?:\\[rn]|[\s\"'+])*([A-Za-z0-9/=][A-Za-z0-9+/=]*)")
_PLACEHOLDER = re.compile(
    r"(?i)^[\"'`]*(?:\$|%[({sd]|\{\{|\{[a-z_.]*\}|<|\[|\(|env\b|process\.env|os\.|await\b|var\.|vault\b|secrets?\.|data\.|none\b|null\b|nil\b|true\b|false\b|str\b|string\b|bytes\b|int\b|any\b|optional|undefined\b|\*+$|x+$|\.+$|-+$|_+$|0+$)"
    r"|example|changeme|change[_-]me|your[_-]|placeholder|redacted|dummy|\bvault[./:]|\{\{|\$\{|^x{4,}|\*{3,}|todo\b|^<|getenv|environ"
)
_WORDISH = re.compile(r"^[A-Za-z]+(?:[_./-][A-Za-z]+)*[.,;:!?)]*$")
_CALL = re.compile(r"^[\w.]+[(\[]")
_SAFE = re.compile(r"(?i)checksum|sha\d*|md5|digest|integrity|commit|request|trace|count|limit|bucket|length|expir|type|url|uri|file|path|name|public|index|max|min|hash\b|tokens\b|_id$")
_SECRET_PATH = re.compile(r"(?i)\.(?:env|ini|ya?ml|toml|tf|conf|cfg|properties|json|npmrc|netrc|pem|key)\b")
_PATH = re.compile(r"(?m)^(?:\+\+\+ b/|diff --git a/|# (?=\S*/\S*$))(\S+)")


class Candidate(NamedTuple):
    line: int
    spans: tuple[tuple[int, int], ...]  # of the value, within the content
    key: str
    value: str
    kind: str  # assign, quoted, said, address, login, bearer, vendor, block
    path: str
    comment: bool


def _unquoted_end(s: str, i: int) -> int:
    m = re.compile(r"[^\s\"'`;,<>)\]}]*").match(s, i)
    return m.end()


def _value(line: str, at: int, op: str) -> tuple[list[tuple[int, int]], str, bool]:
    """Spans, text and quotedness of the value that begins at `at`; strings joined by an operator are one value."""
    spans, text, quoted = [], "", False
    while at < len(line):
        q = line[at]
        if q in "\"'`":
            end = line.find(q, at + 1)
            if end < 0:
                end = _unquoted_end(line, at + 1)
            spans.append((at + 1, end))
            text, quoted = text + line[at + 1:end], True
            more = re.compile(r"[\"'`]?\s*(?:\+|\.\.|\|\||&)\s*(?=[\"'`])").match(line, end)
            if not more:
                break
            at = more.end()
        else:
            end = _unquoted_end(line, at)
            if op == ">" and (close := line.find("<", at)) > 0:
                end = close
            elif op != ">" and line[at] not in "<$({[" and end < len(line) and line[end] in ",)]}" and end + 1 < len(line) and not line[end + 1].isspace() and line[end + 1] not in "\"'":
                end = re.compile(r"[^\s\"'`;]*").match(line, at).end()
            if end > at:
                spans.append((at, end))
                text += line[at:end]
            break
    return spans, text, quoted


def _parts(key: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+", key)]


# Last parts of an identifier that hold a credential.
_LAST = frozenset("password passwd passphrase passcode pass pwd pw secret token apikey accesskey signingkey credential credentials pgpassword".split())


def names_credential(key: str) -> bool:
    p = _parts(key)
    return bool(p) and (p[-1] in _LAST or p[-1] == "key" and len(p) > 1 and p[-2] in _BEFORE_KEY)


def _body(line: str) -> tuple[int, int] | None:
    """Where a line's key material stands, if beside it there is only what quotes, comments, diffs and code put around it."""
    x = line.strip(_AROUND_BODY)
    if x.startswith("//"):
        x = x[2:].lstrip(_AROUND_BODY)
    while x.endswith(("\\n", "\\r")):
        x = x[:-2].rstrip(_AROUND_BODY)
    if not _MATERIAL.fullmatch(x):
        return None
    at = line.index(x)
    return at, at + len(x)


def _wordlike(body: str) -> bool:
    """Whether what may be key material may be a word of the text as well."""
    mixed = any(map(str.isdigit, body)) and any(map(str.isalpha, body)) or not body.isalnum()
    return not mixed and (body.islower() or body.istitle() or len(body) < 48)


def _key_spans(content: str, after: int) -> list[tuple[int, int]]:
    """Spans of the key material behind a header that ends at `after`; none where the header is only mentioned.

    The block goes to its own END line; where there is none, to the first line that can't be key material."""
    line_end = content.find("\n", after)
    line_end = len(content) if line_end < 0 else line_end
    rest = content[after:line_end]
    rest = rest[:stop] if (stop := rest.find("-----")) >= 0 else rest
    inline, at = [], 0
    while m := _IN_LINE.match(rest, at):  # the whole key in one line, its line ends written out
        inline.append((after + m.start(1), after + m.end(1)))
        at = m.end()
    if any(b - a >= 16 for a, b in inline) and (stop >= 0 or not _wordlike(content[inline[0][0]:inline[0][1]])):
        return inline
    spans: list[tuple[int, int]] = []
    at, closed = line_end + 1, False
    while at < len(content):
        end = content.find("\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end]
        if "-----" in line:
            closed = _KEY_END.search(line) is not None
            break
        if x := _body(line):
            spans.append((at + x[0], at + x[1]))
        elif spans or not _KEY_HEADER.match(line):
            break
        at = end + 1
    if not spans or spans[0][1] - spans[0][0] < 16:
        return []
    if not closed:
        for k, (a, b) in enumerate(spans):
            if _wordlike(content[a:b]):
                return spans[:k]
    return spans


def candidates(content: str | None) -> list[Candidate]:
    """Candidate values of a content, line by line."""
    out: list[Candidate] = []
    if not content:
        return out
    seen_to, line_no, path = 0, 1, ""
    paths = _PATH.finditer(content)
    next_path = next(paths, None)
    for a in _hinted(content):
        line_no += content.count("\n", seen_to, a)
        seen_to = a
        b = content.find("\n", a)
        b = len(content) if b < 0 else b
        line = content[a:b]
        while (m := next_path) is not None and m.start() <= a:
            path, next_path = m[1], next(paths, None)
        body = line.lstrip("+- \t")
        comment = body[:1] in "#;/*" or body.startswith(("--", "//"))
        found: list[Candidate] = []

        def add(spans, key, value, kind):
            if value and spans:
                found.append(Candidate(line_no, tuple((a + s, a + e) for s, e in spans), key, value, kind, path, comment))  # noqa: B023

        for m in _KEY_BLOCK.finditer(line):
            add([(x - a, y - a) for x, y in _key_spans(content, a + m.end())], "private key", "block", "block")
        for m in _VENDOR.finditer(line):
            add([m.span()], "", m[0], "vendor")
        for m in _ADDRESS.finditer(line):
            add([m.span("val")], m["key"], m["val"], "address")
        for m in _LOGIN.finditer(line):
            add([m.span("val")], m["key"], m["val"], "login")
        for m in (*_PAIR.finditer(line), *_SHORT_FLAG.finditer(line)):
            add([m.span("val")], m["key"], m["val"], "login")
        for m in _BEARER.finditer(line):
            add([m.span("val")], m["key"], m["val"], "bearer")
        for m in _keyed(_ASSIGN, _ASSIGN_RUN, line):
            spans, value, quoted = _value(line, m.end(), m["op"])
            add(spans, m["key"], value, "quoted" if quoted else "assign")
        for m in _keyed(_SAID, _SAID_RUN, line):
            v = m["val"].strip("\"'`.,;()")
            if v and v[0] not in "=:":
                s = m.start("val") + m["val"].index(v)
                add([(s, s + len(v))], m["key"], v, "said")
        out += found
    return out


# --- Features --------------------------------------------------------------------------------------------------------

_N = 97


def _codes(s: str) -> np.ndarray:
    x = np.frombuffer(s.encode("ascii", "replace"), np.uint8).astype(np.int64) - 31
    return np.where((x < 1) | (x >= _N), 0, x)


_PLAIN = re.compile(r"[A-Za-z_][\w.-]{2,40}")


def _plain(content: str) -> str:
    """The words of a content.  Values of credentials are among them, too few to weigh against the ordinary words."""
    return " ".join(_PLAIN.findall(content))


def _pairs(text: str) -> np.ndarray:
    c = _codes(f" {text} ")
    return np.bincount(c[:-1] * _N + c[1:], minlength=_N * _N)


def _log(counts: np.ndarray) -> np.ndarray:
    n = 0.3 + counts.reshape(_N, _N)
    return np.log(n / n.sum(axis=1, keepdims=True))


class Markov:
    """Likelihood of a text's characters, each given the one before."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def fit(cls, texts: list[str]) -> Markov:
        return cls(_log(sum((_pairs(_plain(t)) for t in texts), np.zeros(_N * _N, np.int64))))

    def mean(self, s: str) -> float:
        c = _codes(" " + s + " ")
        return float(self.table[c[:-1], c[1:]].mean())


def _decoded(v: str) -> str:
    if len(v) >= 8 and len(v) % 4 == 0 and re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v):
        try:
            s = base64.b64decode(v, validate=True).decode("ascii")
            return s if s.isprintable() else ""
        except ValueError:
            pass
    return ""


_KINDS = ("assign", "quoted", "said", "address", "login", "bearer", "vendor")


def features(c: Candidate, model: Markov) -> list[float]:
    v = c.value
    n = max(1, len(v))
    digit, upper, lower = (sum(f(x) for x in v) / n for f in (str.isdigit, str.isupper, str.islower))
    other = 1 - digit - upper - lower
    classes = sum(x > 0 for x in (digit, upper, lower, other))
    placeholder = bool(_PLACEHOLDER.search(v)) or len(set(v)) < 3
    word = bool(_WORDISH.match(v)) and (lower > 0.7 or upper == 1 or v.istitle() or re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)+", v) is not None)
    call = bool(_CALL.match(v))
    return [
        1.0, model.mean(v), min(n, 60) / 20, digit * 2, upper * 2, other * 2, classes - 2.0, float(n < 6), float(placeholder) * 4, float(word) * 3, float(call) * 2,
        float(v.replace(".", "").isdigit()) * 2, float(c.kind in ("address", "login", "bearer", "vendor") or names_credential(c.key)) * 4, float(bool(_SAFE.search(c.key))) * 2, float(bool(_VENDOR.fullmatch(v))) * 3,
        float(bool(re.fullmatch(r"[0-9a-f]{32,}", v))), float(bool(_decoded(v))), float(bool(_SECRET_PATH.search(c.path))), float(c.comment), *(float(c.kind == k) for k in _KINDS),
    ]


def weak_label(c: Candidate) -> int | None:
    """1 or 0 where the patterns are sure, else None."""
    v = c.value
    if c.kind == "block":
        return 1
    if _PLACEHOLDER.search(v) or len(set(v)) < 3:
        return 0
    if _VENDOR.fullmatch(v):
        return 1
    if _CALL.match(v) or v.replace(".", "").isdigit():
        return 0
    known = c.kind in ("address", "login", "bearer") or names_credential(c.key)
    mixed = any(map(str.isdigit, v)) and any(map(str.isalpha, v)) or any(not x.isalnum() and x not in "._-/" for x in v)
    if known and len(v) >= 6 and (mixed and not re.fullmatch(r"[\w.-]*\(.*", v)):
        return 1
    if _WORDISH.match(v) and (v.islower() or v.isupper() or v.istitle() or not names_credential(c.key)):
        return 0
    if not known:
        return 0
    return None


class Scorer:
    """Logistic regression with calibrated scores."""

    def __init__(self, markov: Markov, weights: np.ndarray | None, platt: tuple[float, float] = (1.0, 0.0)):
        self.markov, self.weights, self.platt, self.known = markov, weights, platt, {}

    @classmethod
    def fit(cls, contents: list[str], markov: Markov | None = None) -> Scorer:
        found = [c for t in contents for c in candidates(t)]
        markov = markov or Markov.fit(contents)
        labelled = [(c, y) for c in found if c.kind != "block" and (y := weak_label(c)) is not None]
        ys = np.array([y for _, y in labelled], float)
        if not len(ys) or ys.min() == ys.max():
            return cls(markov, None)
        x = np.array([features(c, markov) for c, _ in labelled])
        fold = np.arange(len(ys)) % 3
        if any(ys[fold != k].min() == ys[fold != k].max() for k in range(3)):
            return cls(markov, _logistic(x, ys))
        ws = [_logistic(x[fold != k], ys[fold != k]) for k in range(3)]
        held = np.array([x[i] @ ws[fold[i]] for i in range(len(ys))])  # each scored by the fit that has not seen it
        # Log odds already: calibration departs from them (slope 1, shift 0) as far as the held-out rows show it.
        a, b = _logistic(np.stack([held, np.ones_like(held)], 1), ys, ridge=0.02 * len(ys), prior=np.array([1.0, 0.0]))
        return cls(markov, np.mean(ws, axis=0), (float(a), float(b)))

    def score(self, c: Candidate) -> float:
        if c.kind == "block":
            return 1.0
        if self.weights is None:
            return float(weak_label(c) or 0)
        if (k := (c.key, c.value, c.kind, c.comment, bool(_SECRET_PATH.search(c.path)))) in self.known:
            return self.known[k]
        a, b = self.platt
        z = a * float(np.dot(features(c, self.markov), self.weights)) + b
        p = 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
        if len(self.known) < 100_000:
            self.known[k] = p
        return p


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40, prior: np.ndarray | None = None) -> np.ndarray:
    """Newton's method, with a pull towards `prior` (zero); both classes weigh the same."""
    prior = np.zeros(x.shape[1]) if prior is None else prior
    w = prior.copy()
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - y)) + ridge * (w - prior)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w


def scan(content: str | None, scorer: Scorer, threshold: float = THRESHOLD) -> list[tuple[int, int, int, float]]:
    """(line, start, end, score) of every credential's value span."""
    out: dict[tuple[int, int, int], float] = {}
    for c in candidates(content):
        s = scorer.score(c)
        if s >= threshold:
            for a, b in c.spans:
                out[c.line, a, b] = max(s, out.get((c.line, a, b), 0.0))
    return sorted((*k, s) for k, s in out.items())


def redact(content: str | None, spans: list[tuple[int, int]], mask: str = MASK) -> str | None:
    """`content` with the spans masked; spans that overlap are masked together."""
    if not spans or content is None:
        return content
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [content[at:a], mask]
        at = b
    return "".join(out) + content[at:]


def _counted(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How often each character follows each other one in the words of all contents, and the number of contents.  What reaches the driver is a table of `_N` x `_N` counts at most."""
    def run(batches):
        counts, n = np.zeros(_N * _N, np.int64), 0
        for b in batches:
            for t in b.column(0):
                n += 1
                counts += _pairs(_plain(t.as_py()))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], ["cell", "n"])

    table, n = np.zeros(_N * _N), 0
    for r in rows.select("content").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        if r["cell"] < 0:
            n = r["n"]
        else:
            table[r["cell"]] = r["n"]
    return table.reshape(_N, _N), n


def train(df: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Scorer:
    """A scorer whose Markov model has counted all contents of `df` (tbl, rec_id, content) and whose regression is fitted
    on the different contents that come first by hash, `sample_rows` of `sample_chars` characters together at most.

    Rows above a hash that twice as many are below are never sent: what reaches the driver is bounded at every size, and a
    group of copies is one content."""
    rows = df.where(F.length("content") > 0).select("content")
    counts, n = _counted(rows)
    share = min(1.0, 2 * sample_rows / max(1, n))
    keyed = rows.withColumn("k", F.xxhash64("content"))
    least = keyed.where(F.col("k") <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else keyed
    sizes = least.groupBy("k").agg(F.max(F.length("content")).alias("n")).orderBy("k").limit(sample_rows).collect()  # two numbers each
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if total > sample_chars:
            break
        last = r["k"]
    if last is None:
        return Scorer.fit([], Markov(_log(counts)))
    return Scorer.fit([r.content for r in least.where(F.col("k") <= last).groupBy("k").agg(F.max("content").alias("content")).orderBy("k").collect()], Markov(_log(counts)))


def find_credentials(df: DataFrame, scorer: Scorer | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(tbl, rec_id, line_no, start_pos, end_pos, score), a row per value span; a credential in parts has several."""
    scorer = scorer or train(df)

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(2)):
                for r in scan(t.as_py(), scorer, threshold):
                    at.append(i), rows.append(r)
            take = pa.array(at, pa.int64())
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64())))], ["tbl", "rec_id", "line_no", "start_pos", "end_pos", "score"])

    return spread(df.select("tbl", "rec_id", "content")).mapInArrow(run, "tbl string, rec_id string, line_no bigint, start_pos int, end_pos int, score double").distinct()


def redact_credentials(df: DataFrame, scorer: Scorer | None = None, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """(tbl, rec_id, redacted, n_values) of every row of `df`: only values are replaced."""
    scorer = scorer or train(df)

    def run(batches):
        for b in batches:
            texts, counts = [], []
            for t in b.column(2):
                t = t.as_py()
                spans = [(s, e) for _, s, e, _ in scan(t, scorer, threshold)]
                texts.append(redact(t, spans, mask)), counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["tbl", "rec_id", "redacted", "n_values"])

    return spread(df.select("tbl", "rec_id", "content")).mapInArrow(run, "tbl string, rec_id string, redacted string, n_values int")
