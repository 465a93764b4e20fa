"""Keyboard layouts as character pairs, for retyping a text on another layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letter rows of the US layout and what the same keys type on others.
US = "qwertyuiop[]asdfghjkl;'zxcvbnm,."
KEYS = {
    "ru": "йцукенгшщзхъфывапролджэячсмитьбю",
    "uk": "йцукенгшщзхїфівапролджєячсмитьбю",
    "el": ";ςερτυθιοπ[]ασδφγηξκλ΄'ζχψωβνμ,.",
}


def pairs(layout: str) -> tuple[str, str]:
    """Characters of the US layout and of another, key by key, where they differ; capitals where both have them."""
    both = [(a, b) for a, b in zip(US, KEYS[layout]) if a != b]
    both += [(a.upper(), b.upper()) for a, b in both if a.isalpha() and b.isalpha() and len(b.upper()) == 1]
    return "".join(a for a, _ in both), "".join(b for _, b in both)


def transcode(text: Column, layout: str, back: bool = False) -> Column:
    """The text as the same keys type it on `layout` (from the US layout), or back."""
    a, b = pairs(layout)
    return F.translate(text, b, a) if back else F.translate(text, a, b)


def round_trips(layout: str) -> bool:
    a, b = pairs(layout)
    return len(set(b)) == len(b) and not set(a) & set(b)


def positions() -> list[tuple[str, int, float]]:
    """(key, row, x) of letter keys: rows are set off by a quarter and three quarters of a key."""
    rows = [("qwertyuiop[]", 0.0), ("asdfghjkl;'", 0.25), ("zxcvbnm,./", 0.75)]
    return [(c, r, i + off) for r, (row, off) in enumerate(rows) for i, c in enumerate(row)]
