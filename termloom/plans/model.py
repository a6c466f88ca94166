"""What the engine asks of a language model."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Protocol

THINK = re.compile(r"\A<think>.*?</think>[\n\r \t]*", re.DOTALL)
Turn = tuple[str, str]


class LanguageModel(Protocol):
    name: str

    def complete(self, turns: Sequence[Turn], prefill: str | None = None) -> str | None:
        """Reply to (role, content) turns, None on failure."""

    def count_tokens(self, text: str) -> int: ...


class NoModel:
    """No model at hand: every call fails, so every fallback applies. Tokens are estimated at three bytes each."""

    name = "none"

    def complete(self, turns: Sequence[Turn], prefill: str | None = None) -> str | None:
        return None

    def count_tokens(self, text: str) -> int:
        return -(-len(text.encode("utf-8")) // 3)


def reply(model: LanguageModel, turns: Sequence[Turn], prefill: str | None = None) -> str | None:
    """The model's reply without a closed think block in front."""
    said = model.complete(turns, prefill)
    return None if said is None else THINK.sub("", said, count=1)


def newest_within(turns: Sequence[Turn], budget: int, model: LanguageModel) -> list[Turn]:
    """The newest turns whose tokens fit the budget; the first that does not fit ends it."""
    kept, used = [], 0
    for turn in reversed(turns):
        used += max(0, model.count_tokens(turn[1]))
        if used > budget:
            break
        kept.append(turn)
    return kept[::-1]
