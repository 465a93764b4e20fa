"""Rough spellings of how words sound, and their likeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingsmith.functions import scripts, transliterate

# The rewrites of an English word, in order; (pattern, replacement), groups as \1.
REWRITES = [
    ("dge", "J"),
    ("dg", "J"),
    ("gg", "G"),
    (r"g(e|es|ed|er|ing|ine)$", r"J\1"),
    ("j", "J"),
    (r"^(.*[^aeiou])a([^aeiou])e$", r"\1EI\2"),
    (r"^(.*[^aeiou])i([^aeiou])e$", r"\1AI\2"),
    (r"^(.*[^aeiou])u([^aeiou])e$", r"\1YU\2"),
    (r"^(.*[^aeiou])([eo])([^aeiou])e$", r"\1\2\3"),
    ("tch", "C"),
    ("sch", "sk"),
    ("tion|sion", "Sn"),
    ("ture", "Cer"),
]
AFTER_GH = [
    ("ph", "f"),
    ("ck", "k"),
    ("qu", "kv"),
    ("wh", "v"),
    ("sh", "S"),
    ("ch", "C"),
    ("th", "t"),
    (r"c([eiy])", r"s\1"),
    ("c", "k"),
    ("oo", "u"),
    ("ee|ea", "i"),
    ("ai|ay", "ei"),
    ("ou", "au"),
    ("ew", "yu"),
    ("ow$", "ou"),
    (r"^(..+u)e$", r"\1"),
    (r"^(..+[^aeiou])e$", r"\1"),
]
HEARD = [("dzh", "J"), ("shch", "S"), ("zh", "J"), ("sh", "S"), ("ch", "C"), ("kh", "h"), ("j", "y")]
FINISH = [("x", "ks"), ("h", ""), (r"(^|[aeiou])y([aeiou])", r"\1Y\2"), (r"(^|[aeiou])y([aeiou])", r"\1Y\2"), ("y", "i"), ("Y", "y")]


def _apply(w: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        w = F.regexp_replace(w, pattern, by.replace("\\", "$"))
    return w


def finish(w: Column) -> Column:
    """Capitals that held vowels back fall, letters of one sound become one, doubles are read once."""
    w = F.translate(w, "AEIYUwqzcG", "aeiyuvkskg")
    return F.regexp_replace(_apply(w, FINISH), r"(.)\1+", "$1")


def english(word: Column) -> Column:
    w = _apply(F.regexp_replace(F.lower(word), "[^a-z]", ""), REWRITES)
    w = F.concat(F.substring(w, 1, 1), F.replace(F.substr(w, F.lit(2)), F.lit("gh"), F.lit("")))
    return finish(_apply(w, AFTER_GH))


def heard(word: Column) -> Column:
    """The key of a word as a recogniser wrote it, in any script but Georgian and Armenian (empty for those)."""
    script = scripts.dominant(word)
    w = F.lower(transliterate.convert(F.lower(word)))
    for pattern, by in HEARD:
        w = F.regexp_replace(w, pattern, by)
    other = finish(F.regexp_replace(w, "[^a-zJSC]", ""))
    return F.when(script.isNull() | script.isin("Georgian", "Armenian"), "").when(script == "Latin", english(word)).otherwise(other)


def skeleton(key: Column) -> Column:
    return F.translate(key, "aeiou", "")


def close(a: Column, b: Column) -> Column:
    """Same last sound, same consonants, and a distance of at most 0, 1 or 2 for keys up to 4, 7 or more letters."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.when(longest <= 4, 0).when(longest <= 7, 1).otherwise(2)
    return (F.right(a, F.lit(1)) == F.right(b, F.lit(1))) & (skeleton(a) == skeleton(b)) & (F.levenshtein(a, b) <= most)


def sql(word: str) -> str:
    """The key of an English word in DuckDB's SQL."""

    w = _chain(f"regexp_replace(lower({word}), '[^a-z]', '', 'g')", REWRITES)
    w = _chain(f"list_transform([{w}], lambda w: substr(w, 1, 1) || replace(substr(w, 2), 'gh', ''))[1]", AFTER_GH)
    return _sql_finish(w)


def _chain(w: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        w = f"regexp_replace({w}, '{pattern}', '{by}', 'g')"
    return w


def _sql_finish(w: str) -> str:
    w = _chain(f"translate({w}, 'AEIYUwqzcG', 'aeiyuvkskg')", FINISH)
    return _chain(w, [(c + "+", c) for c in "abcdefgijklmnoprstuvyJSC"])


def sql_heard(cyrillic: str) -> str:
    """The key of a Cyrillic word in DuckDB's SQL."""
    return _sql_finish(f"regexp_replace({_chain(transliterate.sql(cyrillic, transliterate.CYRILLIC_OUT), HEARD)}, '[^a-zJSC]', '', 'g')")


def doubles_collapsed(key: Column) -> Column:
    return F.regexp_replace(key, r"(.)\1+", "$1")
