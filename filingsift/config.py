"""Settings of an index and of the searches over it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Chunking:
    strategy: str = "section_table"
    size: int = 512
    overlap: int = 64
    header: bool = False

    def __post_init__(self) -> None:
        if self.strategy not in ("fixed", "section", "section_table"):
            raise ValueError(f"unknown strategy {self.strategy}")


@dataclass(frozen=True)
class Embedding:
    provider: str = "hash"
    model: str = "hash-256"


@dataclass(frozen=True)
class Retrieval:
    mode: str = "hybrid"
    top_k: int = 5
    candidates: int = 30
    rrf: int = 60
    metadata_filter: bool = True
    rerank: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("dense", "bm25", "hybrid"):
            raise ValueError(f"unknown mode {self.mode}")


@dataclass(frozen=True)
class Completion:
    provider: str = "offline"
    model: str = "rules"
    temperature: float = 0.0
    max_tokens: int = 800
    price_in: float = 0.40
    price_out: float = 1.60


@dataclass(frozen=True)
class Config:
    name: str = "default"
    parser: str = "layout"
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    completion: Completion = field(default_factory=Completion)

    @property
    def index_id(self) -> str:
        """Identity of the index: what only steers searches does not change it, so such configurations share one."""
        own = {"parser": self.parser, "chunking": asdict(self.chunking), "embedding": asdict(self.embedding)}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:12]


def _made(kind: type, values: dict):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    parts = {"chunking": Chunking, "embedding": Embedding, "retrieval": Retrieval, "completion": Completion}
    return kind(**{k: _made(parts[k], v) if k in parts and not is_dataclass(v) else v for k, v in values.items()})


def load(path: str | Path) -> Config:
    """A configuration from YAML (or JSON, where PyYAML is missing); the name defaults to the file's."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        values = yaml.safe_load(text) or {}
    except ImportError:
        values = json.loads(text)
    return _made(Config, {"name": Path(path).stem} | values)
