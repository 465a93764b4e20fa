"""Hangul syllables as the keys that type them, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of syllables in the order of their code points, and pairs that two keys type.
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
PAIRS = {
    "ㅘ": "ㅗㅏ", "ㅙ": "ㅗㅐ", "ㅚ": "ㅗㅣ", "ㅝ": "ㅜㅓ", "ㅞ": "ㅜㅔ", "ㅟ": "ㅜㅣ", "ㅢ": "ㅡㅣ", "ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ",
    "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ",
}


def decomposed(text: Column) -> Column:
    """Each syllable as its letters in the order of the keys; pairs are taken apart."""

    def letters(c: Column) -> Column:
        at = F.ascii(c) - 0xAC00
        pick = lambda of, i: F.element_at(F.array(*map(F.lit, of)), i.cast("int") + 1)
        syllable = F.concat(pick(LEADS, F.floor(at / 588)), pick(VOWELS, F.floor((at % 588) / 28)), pick(FINALS, at % 28))
        return F.when(c.rlike(r"[\x{AC00}-\x{D7A3}]"), syllable).otherwise(c)

    plain = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), letters), "")
    for whole, keys in PAIRS.items():
        plain = F.replace(plain, F.lit(whole), F.lit(keys))
    return plain


_BACK = {keys: whole for whole, keys in PAIRS.items()}
_V = "(?:" + "|".join([k for k in _BACK if k[0] in VOWELS] + list(VOWELS)) + ")"
_F = "(?:" + "|".join([k for k in _BACK if k[0] not in VOWELS] + FINALS[1:]) + ")"
_SYLLABLE = re.compile(f"([{LEADS}])({_V})((?:{_F})(?!{_V})|[{''.join(FINALS[1:])}](?=[{LEADS}]{_V})|)")


def composed(keys: str) -> str:
    """The syllables that a row of keys types; a consonant before a vowel opens the next syllable."""

    def one(m: re.Match[str]) -> str:
        vowel, final = (_BACK.get(m[i], m[i]) for i in (2, 3))
        return chr(0xAC00 + (LEADS.index(m[1]) * 21 + VOWELS.index(vowel)) * 28 + FINALS.index(final))

    return _SYLLABLE.sub(one, keys)


def composed_column(keys: Column) -> Column:
    """composed, for a column: the pattern needs the syllable that a final moves to, so it runs in Arrow batches."""

    @F.pandas_udf("string")
    def run(batch):  # type: ignore[no-untyped-def]
        return batch.map(composed, na_action="ignore")

    return run(keys)
