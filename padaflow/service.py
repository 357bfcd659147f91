"""Request-level functions for a server: limits, extraction, lookup, labels and health, without a web framework."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from typing import Any

from padaflow.plans.engine import Engine


class TooLarge(ValueError):
    """The request is over a limit (413)."""


def flag(name: str, default: bool = False) -> bool:
    """A truthy environment variable: 1, true, yes or on."""
    raw = os.environ.get(name)
    return default if raw is None else raw.strip().lower() in ("1", "true", "yes", "on")


@dataclass
class Service:
    """An engine behind request limits.  Calls run on the driver; large inputs belong to ``Engine.annotate``."""

    engine: Engine
    most_chars: int = 100_000
    most_texts: int = 256
    origins: tuple[str, ...] = ()

    @classmethod
    def from_env(cls, engine: Engine) -> Service:
        origins = tuple(o.strip() for o in os.environ.get("PADAFLOW_CORS_ORIGINS", "").split(",") if o.strip())
        return cls(engine, int(os.environ.get("PADAFLOW_MAX_CHARS", "100000")), int(os.environ.get("PADAFLOW_MAX_BATCH", "256")), origins)

    def extract(self, text: str, labels: list[str] | None = None, min_confidence: float = 0.0) -> dict[str, Any]:
        if len(text) > self.most_chars:
            raise TooLarge(f"text has more than {self.most_chars} characters")
        local = replace(self.engine.local, labels=frozenset(x.upper() for x in labels or ()), least=min_confidence)
        return {"text": text, "entities": local(text), "lexicon_version": self.engine.version}

    def extract_batch(self, texts: list[str], labels: list[str] | None = None, min_confidence: float = 0.0) -> list[dict[str, Any]]:
        if len(texts) > self.most_texts:
            raise TooLarge(f"more than {self.most_texts} texts")
        return [self.extract(t, labels, min_confidence) for t in texts]

    def lookup(self, q: str) -> list[dict[str, Any]]:
        if not 1 <= len(q) <= 200:
            raise ValueError("a query has 1 to 200 characters")
        return [e.to_dict() for e in self.engine.lookup(q)]

    def labels(self) -> list[str]:
        return sorted({e.label for e in self.engine.local.lexicon.entries})

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "entries": len(self.engine.local.lexicon.entries)}

    def version(self) -> dict[str, str]:
        return {"lexicon_version": self.engine.version}
