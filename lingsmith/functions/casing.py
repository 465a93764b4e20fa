"""Letter case: sentences, words, and the circle UPPER, lower, Sentence, Every Word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingsmith.functions._let import let
from lingsmith.functions.scripts import RANGES

ENDS = r".!?…\n։"
_SHARP = "\ue000"  # stands for ß, which keeps its form in capitals


def upper(text: Column) -> Column:
    """Capitals, letter by letter: ß stays, the Armenian ligature becomes two letters."""
    return F.replace(F.upper(F.replace(F.replace(text, F.lit("ß"), F.lit(_SHARP)), F.lit("և"), F.lit("ԵՒ"))), F.lit(_SHARP), F.lit("ß"))


def final_sigma(text: Column) -> Column:
    return F.regexp_replace(text, f"σ(?![{RANGES['Greek']}])", "ς")


def _opened(text: Column, stops: str, before: str) -> Column:
    """Lower case but for the first letter after each stop, if only characters of `before` come between."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(f"(?s)([^{stops}]+|[{stops}])"), 1)

    def open_one(part: Column) -> Column:
        return let(F.length(F.regexp_extract(part, f"^({before}*)", 1)), lambda head: _capital(part, head))

    return final_sigma(F.array_join(F.transform(parts, open_one), ""))


def _capital(part: Column, head: Column) -> Column:
    first = F.substr(part, head + 1, F.lit(1))
    kept = first.isin("ß", "") | first.rlike(f"[{RANGES['Georgian']}]")
    return F.when(kept, part).otherwise(F.concat(F.substr(part, F.lit(1), head), F.when(first == "և", "Եւ").otherwise(F.upper(first)), F.substr(part, head + 2)))


def sentence_case(text: Column) -> Column:
    return _opened(text, ENDS, r"[^\p{Lu}\p{Ll}\p{Lt}]")


def every_word(text: Column) -> Column:
    """A digit begins a word, so 5th keeps its small letters."""
    return _opened(text, ENDS + r"\s", r"[^\p{L}\p{Nd}]")


def next_case(text: Column) -> Column:
    """The step after the one that the text shows; a step that changes nothing is skipped."""
    has_upper, has_lower = text.rlike(r"\p{Lu}"), text.rlike(r"\p{Ll}")
    return let(
        F.struct(has_upper.alias("upper"), has_lower.alias("lower"), sentence_case(text).alias("sentence"), every_word(text).alias("title")),
        lambda s: F.when(~s["upper"] & ~s["lower"], text)
        .when(s["upper"] & ~s["lower"], final_sigma(F.lower(text)))
        .when(~s["upper"] & (s["sentence"] != text), s["sentence"])
        .when(s["upper"] & (s["sentence"] == text) & (s["title"] != text), s["title"])
        .otherwise(upper(text)),
    )
