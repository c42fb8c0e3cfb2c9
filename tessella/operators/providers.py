"""Embedding and answer providers.  Remote models plug in; the defaults are local and deterministic."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


class Embedder(Protocol):
    provider: str
    model: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of words, at length 1."""

    provider = "local"

    def __init__(self, dim: int = 64, model: str = "hash"):
        self.dim, self.model = dim, model

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


def model_key(provider: str, model: str) -> str:
    """A name that is safe in a path."""
    return re.sub(r"[^\w.-]+", "-", f"{provider}--{model}")


def embed_column(texts: DataFrame, embedder: Embedder, text_col: str = "content", batch: int = 64) -> DataFrame:
    """`texts` with an `embedding` column."""
    @F.pandas_udf(ArrayType(FloatType()))
    def run(s: pd.Series) -> pd.Series:
        parts = [embedder.embed(s.iloc[i:i + batch].fillna("").tolist()) for i in range(0, len(s), batch)]
        return pd.Series([row.tolist() for p in parts for row in np.asarray(p, np.float32)])

    return texts.withColumn("embedding", run(F.col(text_col)))


class RateLimited(Exception):
    def __init__(self, retry_after: float | None = None):
        super().__init__("rate limited")
        self.retry_after = retry_after


class Rules(NamedTuple):
    """How the interval between calls follows what a service says.  All values in seconds, counts or factors."""

    start: float
    least: float
    most: float
    ease: float  # factor of the interval after `oks` successes in a row
    oks: int
    back: float  # factor after a refusal that names no time
    told: float | None = None  # added to a time that a refusal names; None leaves the interval to `back`
    learns: bool = False  # a refused interval is a floor, which `patience` successes near it lower by `thaw`
    near: float = 1.1
    patience: int = 10
    thaw: float = 0.85


# Embedding services, which are paced by the pause before a call, and a chat service, by calls a second.
EMBEDDING = Rules(start=30.0, least=0.2, most=90.0, ease=0.75, oks=3, back=1.5, told=2.0, learns=True)
CHAT = Rules(start=1 / 8, least=1 / 20, most=1.0, ease=1 / 1.05, oks=30, back=1 / 0.4)


class Pace(NamedTuple):
    interval: float
    floor: float
    oks: int = 0
    calm: int = 0
    hold: float = 0.0  # once, before the next call


def started(rules: Rules) -> Pace:
    return Pace(rules.start, rules.least)


def succeeded(p: Pace, rules: Rules) -> Pace:
    floor, calm = p.floor, p.calm
    if rules.learns and p.interval <= rules.near * floor:
        calm += 1
        if calm == rules.patience:
            floor, calm = max(rules.least, floor * rules.thaw), 0
    oks = p.oks + 1
    if oks < rules.oks:
        return Pace(p.interval, floor, oks, calm)
    return Pace(max(floor, p.interval * rules.ease), floor, 0, calm)


def refused(p: Pace, rules: Rules, retry_after: float | None = None) -> Pace:
    """After a refusal; a time that it names is kept to, whatever the interval becomes."""
    named = retry_after is not None and rules.told is not None
    interval = min(rules.most, retry_after + rules.told if named else p.interval * rules.back)
    return Pace(interval, interval if rules.learns else p.floor, hold=retry_after or 0.0)


class Paced:
    """Calls at the pace of `rules`.  One per task: divide a service's budget by the tasks that run at once."""

    def __init__(self, rules: Rules, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rules, self.pace, self.now, self.sleep, self.last = rules, started(rules), now, sleep, None

    def call(self, f: Callable, attempts: int = 5):
        """What `f` returns; a refusal (`RateLimited`) is tried again, `attempts` times in all."""
        for left in range(attempts - 1, -1, -1):
            self.wait()
            try:
                out = f()
            except RateLimited as e:
                self.pace = refused(self.pace, self.rules, e.retry_after)
                if not left:
                    raise
            else:
                self.pace = succeeded(self.pace, self.rules)
                return out
        raise ValueError("at least one attempt")

    def wait(self) -> None:
        """Until an interval after the call before; before the first one only where a service is begun with slowly."""
        now = self.now()
        first = self.pace.interval if self.rules.learns else 0.0
        pause = max(self.pace.hold, first if self.last is None else self.last + self.pace.interval - now, 0.0)
        if pause > 0:
            self.sleep(pause)
        self.last, self.pace = now + pause, self.pace._replace(hold=0.0)


class Throttled:
    """An embedder at a pace, which tries again when refused."""

    def __init__(self, inner: Embedder, attempts: int = 5, rules: Rules = EMBEDDING._replace(start=0.5, least=0.05), sleep: Callable[[float], None] = time.sleep):
        self.inner, self.provider, self.model, self.attempts = inner, inner.provider, inner.model, attempts
        self.paced = Paced(rules, sleep=sleep)

    def embed(self, texts: list[str]) -> np.ndarray:
        return self.paced.call(lambda: self.inner.embed(texts), self.attempts)


class BatchEmbedder(Protocol):
    """A service that takes work now and gives results later, in any order, each with the id it was sent with."""

    def submit(self, texts: dict[str, str]) -> str: ...

    def collect(self, job: str) -> dict[str, list[float]] | None: ...


def collect_batches(jobs: dict[str, BatchEmbedder], poll: float = 30.0, timeout: float = 24 * 3600.0, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> dict[str, dict[str, list[float]]]:
    """Results of jobs submitted beforehand, polled in turn until all are there; after `timeout` seconds it gives up, and
    names the jobs that are still out, which can be collected later."""
    done: dict[str, dict[str, list[float]]] = {}
    began = now()
    while True:
        for job, service in jobs.items():
            if job not in done and (r := service.collect(job)) is not None:
                done[job] = r
        if len(done) == len(jobs):
            return done
        if now() - began >= timeout:
            raise TimeoutError(f"not done after {timeout:.0f} s: {', '.join(sorted(jobs.keys() - done.keys()))}")
        sleep(poll)


class Batched:
    """A batch service as an embedder: a part's texts are submitted, polled for and put in order."""

    def __init__(self, service: BatchEmbedder, provider: str, model: str, poll: float = 30.0, timeout: float = 24 * 3600.0, sleep: Callable[[float], None] = time.sleep):
        self.service, self.provider, self.model, self.poll, self.timeout, self.sleep = service, provider, model, poll, timeout, sleep

    def embed(self, texts: list[str]) -> np.ndarray:
        ids = [str(k) for k in range(len(texts))]
        job = self.service.submit(dict(zip(ids, texts)))
        return in_order(collect_batches({job: self.service}, self.poll, self.timeout, self.sleep)[job], ids)


def in_order(results: dict[str, list[float]], ids: list[str]) -> np.ndarray:
    """Vectors in the order of `ids`; a missing or surplus one is an error."""
    if len(results) != len(ids) or any(i not in results for i in ids):
        raise ValueError(f"{len(ids)} texts were sent, {len(results)} vectors came back")
    out = np.array([results[i] for i in ids], np.float32)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


class AnswerProvider(Protocol):
    def generate(self, messages: list[dict[str, str]], temperature: float = 0.3, max_tokens: int = 1024) -> str: ...

