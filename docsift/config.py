"""Tunables of the retrieval engine and the signatures made of them."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    # Recall depths, fusion, ranking and chunking constants that results depend on.
    dense_top_k: int = 30
    bm25_top_k: int = 30
    fused_top_k: int = 20
    rerank_top_k: int = 5
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rerank_threshold: float | None = None
    prompt_chars: int = 4000
    query_instruction: str = ""
    chunk_min: int = 800
    chunk_target: int = 1000
    chunk_soft: int = 1200
    chunk_hard: int = 1500
    section_aware: bool = True
    plain_size: int = 800
    plain_overlap: int = 150
    margin_pages: int = 3
    margin_hits: int = 3
    margin_share: float = 0.6

    def signature(self) -> str:
        """Changes whenever a constant does; stored beside what was built with it."""
        return fingerprint(asdict(self))

    def _part(self, *prefixes: str) -> str:
        return fingerprint({k: v for k, v in asdict(self).items() if k.startswith(prefixes)} | {"rules": RULES})

    def chunking_signature(self) -> str:
        """Changes with what decides where chunks begin and end."""
        return self._part("chunk_", "section_", "plain_")

    def bm25_signature(self) -> str:
        """Changes with what decides sparse scores."""
        return self._part("bm25_")

    def pipeline_signature(self, embedding: str) -> str:
        """Changes with anything between a file and its vectors; ``embedding`` names the model and its settings."""
        return fingerprint({"rules": RULES, "chunks": self.chunking_signature(), "margins": [self.margin_pages, self.margin_hits, self.margin_share], "embedding": embedding})


#: Raised when a rule of parsing, cleaning, chunking or tokenising changes its results.
RULES = 2


def fingerprint(value: object) -> str:
    """Hash of a value as canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def code_snapshot(root: str, pattern: str = "**/*.py") -> dict[str, str]:
    """Hash of each source file under a folder, for the signature of a run."""
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(Path(root).glob(pattern))}


class ConfigError(ValueError):
    """A setting that is missing or of the wrong kind."""


def load(path: str | None = None, environment: dict[str, str] | None = None, prefix: str = "DOCSIFT_") -> Config:
    """The settings: environment before file before default.

    The file has lines of NAME=value, blank ones and comments left out; names are those of ``Config`` in capitals with the prefix.
    """
    values: dict[str, str] = {}
    if path and Path(path).is_file():
        lines = [x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines()]
        pairs = (x.split("=", 1) for x in lines if x and not x.startswith("#") and "=" in x)
        values = {k.strip(): v.strip().strip("\"'") for k, v in pairs}
    values |= os.environ if environment is None else environment
    kinds = {"int": int, "float": float, "str": str, "bool": lambda v: {"true": True, "1": True, "false": False, "0": False}[v.lower()], "float | None": lambda v: float(v) if v else None}
    given = {}
    for f in fields(Config):
        raw = values.get(prefix + f.name.upper())
        if raw is not None:
            try:
                given[f.name] = kinds[str(f.type)](raw)
            except (KeyError, ValueError):
                raise ConfigError(f"{prefix}{f.name.upper()} is no {f.type}") from None
    return replace(Config(), **given)


def require(settings: dict[str, str | None], *names: str) -> None:
    """Raises for the settings that are missing or blank."""
    lacking = [n for n in names if not (settings.get(n) or "").strip()]
    if lacking:
        raise ConfigError("missing: " + ", ".join(lacking))


DEFAULT = Config()
