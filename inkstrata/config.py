"""Settings with the defaults that results depend on, checked when made; and their loading from YAML or JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


def _need(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


@dataclass(frozen=True)
class Chunking:
    window: int = 4
    stride: int = 2
    min_chars: int = 40
    max_chars: int = 1800
    max_propositions: int = 8
    min_score: float = 0.45

    def __post_init__(self) -> None:
        _need(min(self.window, self.stride, self.min_chars) >= 1, "window, stride and min_chars must be 1 or more")


@dataclass(frozen=True)
class Pairing:
    max_qa: int = 2
    summary: bool = True
    min_propositions: int = 1
    require_citation: bool = True

    def __post_init__(self) -> None:
        _need(self.max_qa >= 0 and self.min_propositions >= 0, "max_qa and min_propositions must be 0 or more")


@dataclass(frozen=True)
class Filtering:
    instruction_chars: tuple[int, int] = (12, 600)
    output_chars: tuple[int, int] = (40, 4000)
    min_context_chars: int = 40
    require_citation: bool = True
    require_marker: bool = True
    near_dup: float = 0.88
    compare_limit: int = 64
    use_judge: bool = False
    min_judge_score: float = 0.6

    def __post_init__(self) -> None:
        _need(self.instruction_chars[0] >= 0 and self.output_chars[0] >= 0, "length floors must be 0 or more")
        _need(0 <= self.near_dup <= 1 and 0 <= self.min_judge_score <= 1, "near_dup and min_judge_score must be in [0, 1]")


@dataclass(frozen=True)
class Selection:
    target_min: int = 3000
    target_max: int = 6000
    max_per_source: int = 2500
    max_per_task: int = 4000
    max_per_source_task: int = 2000
    diversity: float = 0.72
    train: float = 0.8
    val: float = 0.1
    test: float = 0.1
    seed: int = 94
    #: Part of the split's hash, so it must be kept for equal splits.
    version: str = "sft-v0.1.0"

    def __post_init__(self) -> None:
        _need(0 <= self.target_min <= self.target_max, "0 <= target_min <= target_max must hold")
        _need(min(self.max_per_source, self.max_per_task, self.max_per_source_task) >= 1, "caps must be 1 or more")
        _need(0 <= self.diversity <= 1, "diversity must be in [0, 1]")
        _need(min(self.train, self.val, self.test) >= 0 and abs(self.train + self.val + self.test - 1) <= 1e-6, "fractions must be 0 or more and sum to 1")


@dataclass(frozen=True)
class Retrieval:
    k1: float = 1.5
    b: float = 0.75
    dim: int = 128
    rrf_k: int = 60
    pool: int = 50
    k_values: tuple[int, ...] = (1, 3, 5, 10)
    top_k: int = 5
    context_chars: int = 3500


@dataclass(frozen=True)
class EvalSet:
    seed: int = 3407
    size: int = 50


@dataclass(frozen=True)
class Settings:
    """All sections of a settings file; what no section knows is kept in ``extras``."""

    chunking: Chunking = field(default_factory=Chunking)
    pairing: Pairing = field(default_factory=Pairing)
    filtering: Filtering = field(default_factory=Filtering)
    selection: Selection = field(default_factory=Selection)
    retrieval: Retrieval = field(default_factory=Retrieval)
    eval_set: EvalSet = field(default_factory=EvalSet)
    extras: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Settings:
        kinds = {"chunking": Chunking, "pairing": Pairing, "filtering": Filtering, "selection": Selection, "retrieval": Retrieval, "eval_set": EvalSet}
        made, extras = {}, {k: v for k, v in raw.items() if k not in kinds}
        for name, kind in kinds.items():
            known = {f.name for f in fields(kind)}
            own = raw.get(name) or {}
            made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in known})
            if rest := {k: v for k, v in own.items() if k not in known}:
                extras[name] = rest
        return cls(**made, extras=extras)


BUNDLED = Path(__file__).parent / "configs"


def resolve(path: str | Path | None = None) -> Path:
    """A settings file: the bundled default without a path, else the file there is, else the bundled one of the same name."""
    if path is None:
        return BUNDLED / "default.json"
    for p in (Path(path), BUNDLED / Path(path).name):
        if p.exists():
            return p
    raise FileNotFoundError(f"no settings at {path}, and none of that name are bundled")


def load_settings(path: str | Path | None = None) -> Settings:
    """From JSON, or YAML if a YAML parser is installed."""
    found = resolve(path)
    text = found.read_text(encoding="utf-8")
    if found.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("reading YAML settings needs a YAML parser; use JSON") from e
        raw = yaml.safe_load(text) or {}
    elif found.suffix == ".json":
        raw = json.loads(text)
    else:
        raise ValueError(f"settings are JSON or YAML, not {found.suffix!r}")
    if not isinstance(raw, dict):
        raise TypeError(f"settings are a mapping, not {type(raw).__name__}")
    return Settings.of(raw)
