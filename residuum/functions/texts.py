"""Small text measures."""

from __future__ import annotations


def token_estimate(text: str) -> str:
    """Tokens of a text by the character rule used when no tokenizer is at hand."""
    return f"CAST(floor(length({text}) / 2.9D) AS BIGINT) + 1"


def contains_word(text: str, word: str, any_case: bool = True) -> str:
    """Whole-word search for a literal, by default in any case; both arguments are SQL text."""
    return f"{text} RLIKE concat('{'(?iU)' if any_case else ''}(?<![A-Za-z0-9])\\\\Q', {word}, '\\\\E(?![A-Za-z0-9])')"
