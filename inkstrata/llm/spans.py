"""Spans of a text: (kind, start, end) in code points, end exclusive, and their digests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

Span = tuple[str, int, int]


def all_of(kind: str, pattern: re.Pattern, text: str, good: Callable[[re.Match], bool] = lambda m: True) -> Iterable[Span]:
    """Leftmost matches that don't overlap; those that fail ``good`` are dropped without another try."""
    return ((kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m))


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind in the order of ``kinds``."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end in that order, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans, kinds))


def digest(line: str) -> str:
    return hashlib.sha256(line.encode()).hexdigest()
