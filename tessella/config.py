"""Settings: defaults, a TOML file, and the environment."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from pathlib import Path

ENV = "TESSELLA_CONFIG"


# The sections of a settings file, and every setting with its default.
SETTINGS = {
    "data": {"raw_dir": "data/raw", "index_dir": "data/index"},
    "ingest": {"batch_size": 32, "max_chunk_tokens": 512, "chunk_overlap_tokens": 64},
    "embedding": {"provider": "local", "model_name": "hash", "device": "cpu", "models": ()},
    "reranker": {"provider": "local", "model_name": "overlap", "device": "cpu"},
    "retrieval": {"top_k_dense": 20, "top_k_bm25": 20, "top_k_rerank": 5, "rrf_k": 60, "dedup_threshold": 0.0},
    "generation": {"model": "none", "url": "", "temperature": 0.3, "max_tokens": 1024},
}


class Section(Mapping):
    """Settings of a section, by name or as attributes; what isn't given has its default, and an unknown name is an error."""

    def __init__(self, name: str, defaults: Mapping, given: Mapping):
        if unknown := sorted(given.keys() - defaults.keys()):
            raise TypeError(f"unknown settings in {name}: {', '.join(unknown)}")
        self._values = {**defaults, **given}

    def __getitem__(self, key: str):
        return self._values[key]

    def __iter__(self):
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def __getattr__(self, key: str):
        if key.startswith("_") or key not in self._values:
            raise AttributeError(key)
        return self._values[key]


class Config:
    """All sections of `SETTINGS`; `scrape` is free, a mapping by source."""

    def __init__(self, given: Mapping | None = None):
        given = given or {}
        for name, defaults in SETTINGS.items():
            setattr(self, name, Section(name, defaults, given.get(name, {})))
        self.scrape = dict(given.get("scrape", {}))
        if self.ingest.chunk_overlap_tokens >= self.ingest.max_chunk_tokens:
            raise ValueError("chunk_overlap_tokens must be smaller than max_chunk_tokens")

    def models(self) -> list[Section]:
        """The embedding models: those listed, else the section's own."""
        one = {k: v for k, v in SETTINGS["embedding"].items() if k != "models"}
        own = {k: self.embedding[k] for k in one}
        return [Section("embedding.models", one, m) for m in self.embedding.models or (own,)]


def from_mapping(raw: dict) -> Config:
    return Config(raw)


def find(path: str | None = None) -> Path | None:
    """The file named, else the one of the environment, else config.toml here, else the user's."""
    for p in (path, os.environ.get(ENV)):
        if p:
            return Path(p)
    home = Path(os.environ.get("XDG_CONFIG_HOME", Path.home() / ".config"))
    return next((p for p in (Path("config.toml"), home / "tessella" / "config.toml") if p.exists()), None)


def load(path: str | None = None) -> Config:
    p = find(path)
    return from_mapping(tomllib.loads(p.read_text())) if p else Config()


def load_env(path: str = ".env") -> dict[str, str]:
    """NAME=value lines of a file, put into the environment where they are not there yet."""
    p, out = Path(path), {}
    if p.exists():
        for line in p.read_text().splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and name and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("\"'")
                os.environ.setdefault(name.strip(), out[name.strip()])
    return out
