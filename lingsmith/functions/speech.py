"""Cleaning of dictated text: fillers, loops, cut-off repeats, spoken punctuation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingsmith.functions._let import let
from lingsmith.functions.text import normalised

MARK = "\x1f"


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences: cut at blanks after . ! ? …"""
    parts = F.split(F.regexp_replace(text, r"([.!?…])\s+", "$1" + MARK), MARK)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def is_filler(sentence: Column, exact: list[str], markers: list[str]) -> Column:
    """Nothing but punctuation, one of the phrases, or a phrase that holds a marker; all in normalised form."""

    def told(n: Column) -> Column:
        out = n.isin("", *exact)
        for m in markers:
            out = out | n.contains(m)
        return out

    return let(normalised(sentence), told)


def without_loops(items: Column) -> Column:
    """Sentences unlike the one before them, compared in normalised form."""
    return let(items, lambda all_: F.filter(all_, lambda s, i: (i == 0) | (normalised(s) != normalised(F.get(all_, i - 1)))))


def without_cut_off(items: Column) -> Column:
    """Drops a last sentence of two words or more with which an earlier, longer one begins."""

    def shortened(all_: Column, last: Column) -> Column:
        earlier = F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0)))
        cut = F.exists(earlier, lambda s: let(normalised(s), lambda n: (F.length(n) > F.length(last)) & n.startswith(last)))
        return F.when((F.size(all_) >= 2) & last.contains(" ") & cut, earlier).otherwise(all_)

    return let(items, lambda all_: let(normalised(F.try_element_at(all_, F.lit(-1))), lambda last: F.when(F.size(all_) < 2, all_).otherwise(shortened(all_, last))))


def one_copy_each(text: str) -> str:
    """One copy of runs of up to ten words said three times or more; of a single word, four times or more."""
    words = [w for w in text.split(" ") if w]
    keys = [" ".join(re.findall(r"[^\W_]+", w.lower())) for w in words]
    for n in range(10, 0, -1):
        needed = n * (3 if n == 1 else 2)
        same, at = 0, len(words) - n - 1
        starts = []
        while at >= 0:  # same: how many words from here on equal those n further on
            same = same + 1 if keys[at] == keys[at + n] else 0
            if same >= needed:
                starts.append((at, same))
            at -= 1
        upto = -1
        gone = set()
        for at, same in reversed(starts):
            if at <= upto or not any(keys[at : at + n]):
                continue
            upto = at + same // n * n
            gone.update(range(at + n, at + n + same // n * n))
        if gone:
            words = [w for i, w in enumerate(words) if i not in gone]
            keys = [k for i, k in enumerate(keys) if i not in gone]
    return " ".join(words)


def cleaned(docs: DataFrame, exact: list[str], markers: list[str], column: str = "text") -> DataFrame:
    """The rows with fillers, loops, a cut-off repeat and repeated runs taken out of a column; null stays null."""
    kept = F.filter(sentences(F.col(column)), lambda s: ~is_filler(s, exact, markers))
    joined = docs.withColumn(column, F.array_join(without_cut_off(without_loops(kept)), " "))

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{column: b[column].map(lambda x: one_copy_each(x) if isinstance(x, str) else None)})

    return joined.mapInPandas(collapse, joined.schema)


def spoken_marks(text: Column, phrases: dict[str, str]) -> Column:
    """Phrases that name a mark become it, longest first, closed up to the word before."""
    for phrase in sorted(phrases, key=lambda p: (-len(p), p)):
        text = F.regexp_replace(text, rf"(?i)[ ,]*\b{phrase}\b[.,]?", phrases[phrase])
    return text


def fit_after(text: Column, before: Column) -> Column:
    """The text as it continues `before`: a small first letter inside a sentence, a blank where one is needed."""
    from lingsmith.functions.text import decapitalised

    ended = F.regexp_replace(before, r"\s+$", "").rlike(r"(^|[.!?…])$")
    body = F.when(ended, text).otherwise(decapitalised(text))
    joined = (before == "") | before.rlike(r"\s$") | text.rlike(r"^[\s.,!?:;)…]")
    return F.when(joined, body).otherwise(F.concat(F.lit(" "), body))


def tail(text: Column, most: int) -> Column:
    """The last `most` characters of a trimmed text, from the word that begins first in them."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    cut = F.right(whole, F.lit(most))
    space = F.instr(cut, " ")
    return F.when(F.length(whole) <= most, whole).when((space > 0) & (space < most), F.substr(cut, space + 1)).otherwise(cut)


def fitted(terms: Column, room: Column) -> Column:
    """Terms joined by commas as long as they fit; empty ones and those that stand in it already are skipped, and the
    first that doesn't fit ends it."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(acc: Column, raw: Column) -> Column:
        term = F.trim(raw)
        skip = acc["full"] | (term == "") | F.contains(acc["text"], term)
        full = F.length(acc["text"]) + F.length(term) + 2 > room
        longer = F.when(acc["text"] == "", term).otherwise(F.concat(acc["text"], F.lit(", "), term))
        return F.when(skip, acc).when(full, F.struct(acc["text"].alias("text"), F.lit(True).alias("full"))).otherwise(F.struct(longer.alias("text"), F.lit(False).alias("full")))

    return F.aggregate(terms, start, add, lambda acc: acc["text"])


def prompt(sample: Column, terms: Column, before: Column, most: int = 360, most_before: int = 120) -> Column:
    """A sample, the terms that fit between, and the tail of the text before."""
    end = tail(before, most_before)
    found = fitted(terms, F.lit(most) - F.length(sample) - F.length(end) - 2)
    parts = F.array(sample, F.when(found == "", "").otherwise(F.concat(found, F.lit("."))), end)
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def collapsed(text: Column) -> Column:
    """one_copy_each, for a column: runs are equal under their keys, not as written, so it runs in Arrow batches."""

    @F.pandas_udf("string")
    def run(batch):  # type: ignore[no-untyped-def]
        return batch.map(one_copy_each, na_action="ignore")

    return run(text)
