"""Texts in the letters of another script, by ordered tables, with capitals carried over."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingsmith.functions import scripts
from lingsmith.functions._let import let
from lingsmith.functions.casing import final_sigma

# Letters and what stands for them, in the order in which they are tried.
CYRILLIC_OUT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "j",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu",
    "я": "ya", "і": "i", "ї": "ji", "є": "je", "ґ": "g", "ў": "w",
}
BULGARIAN_OUT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "ѝ": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "y", "ю": "yu", "я": "ya",
}
CYRILLIC_IN = {
    "shch": "щ", "yo": "ё", "yu": "ю", "ya": "я", "zh": "ж", "kh": "х", "ts": "ц", "ch": "ч", "sh": "ш", "a": "а",
    "b": "б", "c": "ц", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "й", "k": "к", "l": "л",
    "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в",
    "x": "кс", "y": "ы", "z": "з",
}
GREEK_OUT = {
    "ού": "ou", "ου": "ou", "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i",
    "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t",
    "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o", "ά": "a", "έ": "e", "ή": "i", "ί": "i", "ό": "o", "ύ": "y",
    "ώ": "o", "ϊ": "i", "ϋ": "y", "ΐ": "i", "ΰ": "y",
}
GREEK_IN = {
    "ou": "ου", "th": "θ", "ch": "χ", "ps": "ψ", "a": "α", "b": "β", "c": "κ", "d": "δ", "e": "ε", "f": "φ", "g": "γ",
    "h": "η", "i": "ι", "j": "ι", "k": "κ", "l": "λ", "m": "μ", "n": "ν", "o": "ο", "p": "π", "q": "κ", "r": "ρ",
    "s": "σ", "t": "τ", "u": "υ", "v": "β", "w": "ω", "x": "ξ", "y": "υ", "z": "ζ",
}


def pieces_pattern(table: dict[str, str]) -> str:
    return "(" + "|".join(map(re.escape, table)) + "|.)"


def rewritten(text: Column, table: dict[str, str]) -> Column:
    """Each piece as the table has it; a capital gives capitals in an upper-case run, else one capital."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    parts = F.regexp_extract_all(text, F.lit("(?isu)" + pieces_pattern(table)), 1)
    return let(parts, lambda parts: _joined(parts, known))


def _joined(parts: Column, known: Column) -> Column:
    def one(part: Column, at: Column) -> Column:
        return F.when(part.rlike(r"^\p{Lu}"), let(F.try_element_at(known, F.lower(part)), lambda to: capital(part, at, to))).otherwise(F.coalesce(F.try_element_at(known, part), part))

    def capital(part: Column, at: Column, to: Column) -> Column:
        beside = lambda i: F.when((i >= 0) & (i < F.size(parts)), F.get(parts, i))
        after, before = F.substring(beside(at + 1), 1, 1), F.right(beside(at - 1), F.lit(1))
        run = F.when(after.rlike(r"\p{L}"), after.rlike(r"\p{Lu}")).when(before.rlike(r"\p{L}"), before.rlike(r"\p{Lu}")).otherwise(F.lit(False))
        loud = F.when(F.length(part) > 1, F.substring(part, 2, 1).rlike(r"\p{Lu}")).otherwise(run)
        return F.when(to.isNull(), part).when(loud, F.upper(to)).otherwise(F.concat(F.upper(F.substring(to, 1, 1)), F.substr(to, F.lit(2))))

    return F.array_join(F.transform(parts, one), "")


def convert(text: Column, latin_to: str = "Cyrillic") -> Column:
    """By dominant script: Cyrillic and Greek to Latin, Latin to `latin_to`; others as they are."""
    there = final_sigma(rewritten(text, GREEK_IN)) if latin_to == "Greek" else rewritten(text, CYRILLIC_IN)
    by_script = lambda s: F.when(s == "Cyrillic", rewritten(text, CYRILLIC_OUT)).when(s == "Greek", rewritten(text, GREEK_OUT)).when(s == "Latin", there).otherwise(text)
    return let(scripts.dominant(text), by_script)


def sql(text: str, table: dict[str, str]) -> str:
    """Small letters only, in DuckDB's SQL."""
    known = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in table.items()) + "}"
    return f"array_to_string(list_transform(regexp_extract_all(lower({text}), '(?s){pieces_pattern(table)}'), lambda x: coalesce({known}[x], x)), '')"
