"""Defaults of the engine, read from the environment once, and the bounds of its arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import cache

#: Least and largest of what a caller may ask for.
BOUNDS = {"ask_top_k": (1, 10), "search_top_k": (1, 20), "chunks_top_k": (1, 50), "depth": (1, 4), "symbols": (1, 100), "eval_limit": (1, 500)}
LEAST_QUESTION = 3


@dataclass(frozen=True)
class Settings:
    top_k: int = 20
    rerank_top_n: int = 12
    max_tokens: int = 2500
    max_expanded: int = 15
    answer_seconds: int = 300
    dimensions: int = 64


@cache
def settings(prefix: str = "TESSERA_") -> Settings:
    """Each field from its environment variable (TESSERA_TOP_K, ...), else its default."""
    named = {f.name: int(os.environ[prefix + f.name.upper()]) for f in fields(Settings) if prefix + f.name.upper() in os.environ}
    return Settings(**named)


def bounded(name: str, value: int) -> int:
    """``value``, or an error where it lies outside the argument's bounds."""
    least, most = BOUNDS[name]
    if not least <= value <= most:
        raise ValueError(f"{name} must be from {least} to {most}, not {value}")
    return value


def asked(question: str) -> str:
    """The trimmed question, or an error where it is too short to mean anything."""
    if len(question.strip()) < LEAST_QUESTION:
        raise ValueError(f"a question has {LEAST_QUESTION} characters at least")
    return question.strip()
