"""Settings of retrieval and context: defaults, then a file, then the environment.

A file is JSON with sections; keys that aren't known are an error, so a typo
doesn't pass as a default.
"""

from __future__ import annotations

import dataclasses
import json
import os
from pathlib import Path
from typing import Any

ENV = "LOOMGRAPH_"


@dataclasses.dataclass(frozen=True)
class Retrieval:
    top_k_vector: int = 20
    top_k_bm25: int = 20
    rerank_top_n: int = 8
    final_top_n: int = 5
    graph_expand: bool = True
    graph_expand_limit: int = 4
    fusion: str = "rrf"
    rrf_k: int = 60
    weight_vector: float = 0.5
    weight_bm25: float = 0.5
    rerank: bool = True

    def __post_init__(self) -> None:
        if self.fusion not in ("rrf", "weighted"):
            raise ValueError(f"fusion must be rrf or weighted, not {self.fusion}")
        if min(self.top_k_vector, self.top_k_bm25, self.rerank_top_n, self.final_top_n, self.rrf_k) < 1:
            raise ValueError("sizes must be 1 at least")

    @property
    def cut(self) -> int:
        """Fused candidates that are boosted at all."""
        return 2 * max(self.rerank_top_n, self.final_top_n)


@dataclasses.dataclass(frozen=True)
class Context:
    token_budget: int = 4000
    entry: float = 0.20
    graph: float = 0.30
    retrieval: float = 0.40
    tier: float = 0.10
    code_share: float = 0.70
    graph_share: float = 0.15
    history_share: float = 0.10
    history_window: int = 1


@dataclasses.dataclass(frozen=True)
class Watch:
    """Milliseconds; what is asked for is kept within bounds."""

    debounce_ms: int = 2000
    poll_ms: int = 1500

    def __post_init__(self) -> None:
        for name, low, high in (("debounce_ms", 100, 60_000), ("poll_ms", 200, 60_000)):
            object.__setattr__(self, name, min(max(int(getattr(self, name)), low), high))


def _typed(kind: type, text: str) -> Any:
    if kind is bool:
        return text.strip().lower() in ("1", "true", "yes", "on")
    return kind(text)


def load(cls: type, section: str, path: str | Path | None = None, env: dict[str, str] | None = None, **given: Any) -> Any:
    """Settings ``cls``: from section of a JSON file, then LOOMGRAPH_<SECTION>_<NAME>, then what is given and not None."""
    kinds = {f.name: type(f.default) for f in dataclasses.fields(cls)}
    values: dict[str, Any] = {}
    if path is not None and Path(path).exists():
        read = json.loads(Path(path).read_text(encoding="utf-8"))
        own = read.get(section, {}) if isinstance(read, dict) else None
        if not isinstance(own, dict):
            raise ValueError(f"not a settings file: {path}")
        values |= own
    for name, text in (os.environ if env is None else env).items():
        key = name.removeprefix(f"{ENV}{section.upper()}_").lower()
        if name.startswith(f"{ENV}{section.upper()}_") and key in kinds:
            values[key] = _typed(kinds[key], text)
    values |= {k: v for k, v in given.items() if v is not None}
    unknown = set(values) - set(kinds)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return cls(**values)
