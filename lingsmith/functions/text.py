"""Text transforms and tests as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingsmith.functions import casing
from lingsmith.functions._let import let
from lingsmith.functions.scripts import ABJAD, RANGES


def normalised(text: Column) -> Column:
    """Lower case, letters and digits only, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "))


def skeleton(word: Column) -> Column:
    """Consonants of a word of plain letters."""
    return F.translate(F.lower(word), "aeiou", "")


def caps_slip(word: Column) -> Column:
    """caps: typed with Caps Lock and Shift; double: with two capitals at the start."""
    doubled = word.rlike(r"^\p{Lu}{2}\p{Ll}+$") & ~(word.endswith("s") & (F.length(word) == 3))
    return F.when(word.rlike(r"^\p{Ll}\p{Lu}{4,}$"), "caps").when(doubled, "double")


def decapitalised(text: Column) -> Column:
    """The first word in small letters, unless it is I or has further capitals."""
    first = F.regexp_extract(text, r"^(\p{Lu}\p{Ll}+)", 1)
    return F.when(first != "", F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))).otherwise(text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1)


def swapped(word: Column, at: Column) -> Column:
    """The word with the letters at `at` and after it in each other's place (from 1)."""
    part = lambda first, n: F.substr(word, first, n)
    return F.concat(part(F.lit(1), at - 1), part(at + 1, F.lit(1)), part(at, F.lit(1)), F.substr(word, at + 2))


def language_code(tag: Column) -> Column:
    """uk of uk-UA or uk_UA."""
    return F.lower(F.regexp_extract(tag, "^([^-_]*)", 1))


def caps_lock_undone(words: DataFrame, by: list[str]) -> DataFrame:
    """(…by, pos, word) of rows (…by, pos, w): once a word of five letters shows Caps Lock, such words are put right."""
    w = F.col("w")
    so_far = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    on = F.max(w.rlike(r"^\p{Ll}\p{Lu}{4,}$")).over(so_far)
    turned = F.concat(casing.upper(F.substring("w", 1, 1)), F.lower(F.expr("substring(w, 2)")))
    fixed = F.when(F.col("on") & w.rlike(r"^\p{Lu}{2,}$"), F.lower("w")).when(F.col("on") & w.rlike(r"^\p{Ll}\p{Lu}+$"), turned).otherwise(w)
    return words.withColumn("on", on).select(*by, "pos", fixed.alias("word"))


def auto_eligible(word: Column, signs: str, shift_letters: str, directed: bool = False, digits: str = "", least: int = 3) -> Column:
    """Whether a chunk may be corrected unasked: letters and signs that type letters elsewhere, a small letter, and no
    later capital but those of keys whose shift types a letter, or a slip of the shift keys.

    On a line with a direction one letter is enough, and so are signs alone.
    """
    core = F.regexp_replace(word, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")
    sign = re.escape(signs)
    allowed = core.rlike(rf"^[\p{{L}}{sign}{re.escape(digits)}]*$")
    inner = F.expr("1=1") if not shift_letters else ~F.substr(core, F.lit(2)).rlike(rf"[\p{{Lu}}&&[^{shift_letters}]]")
    ok = (F.length(core) >= (1 if directed else least)) & allowed & core.rlike(r"[\p{L}&&[^\p{Lu}]]") & (inner | caps_slip(core).isNotNull())
    return F.when((core == "") & (word != ""), word.rlike(rf"^[{sign}]+$")).otherwise(ok) if directed else ok


def letters_key(word: Column) -> Column:
    """What stands between a chunk's first and last letter, in small letters."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}]+|[^\p{L}]+$", ""))


def term_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}](?:[\p{L}\p{M}\p{Nd}]|['’](?=\p{L}))*)"), 1)


def covers_letters(text: Column, spans: Column) -> Column:
    """Whether spans (start from 0, end) hold every letter of a text that has one; what lies beyond the text is cut off."""
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)
    outside = lambda spans: F.filter(chars, lambda c, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    return ~F.array_join(let(spans, outside), "").rlike(r"\p{L}") & text.rlike(r"\p{L}")


def hebrew_finals(text: Column) -> Column:
    """Letters with a final form take it before anything that isn't a Hebrew letter."""
    for plain, final in zip("כמנפצ", "ךםןףץ"):
        text = F.regexp_replace(text, f"{plain}(?![{RANGES['Hebrew']}])", final)
    return text


def flipped(text: Column) -> Column:
    """Lines in visual order where the text has Hebrew or Arabic letters: units reversed, brackets mirrored.

    Letters with their marks are one unit, and so is a run of digits and letters that are read from the left.
    """
    left = "0-9" + "".join(r for s, r in RANGES.items() if s not in ABJAD)
    units = F.lit(rf"(?:[{left}]\p{{M}}*)+|\X")

    def unit(u: Column) -> Column:
        return F.when(F.length(u) == 1, F.translate(u, "()[]{}<>«»‹›", ")(][}{><»«›‹")).otherwise(u)

    def line(x: Column) -> Column:
        core = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
        turned = F.array_join(F.transform(F.reverse(F.regexp_extract_all(core, units, 0)), unit), "")
        edges = F.regexp_extract(x, r"(?U)^(\s*)", 1), F.regexp_extract(x, r"(?U)(?<!\s)(\s*)$", 1)
        return F.when(core == "", x).otherwise(F.concat(edges[0], turned, edges[1]))

    lines = F.regexp_extract_all(text, F.lit(r"(?s)([^\r\n]+|[\r\n])"), 1)
    out = F.array_join(F.transform(lines, lambda x: F.when(x.rlike("^[\r\n]$"), x).otherwise(line(x))), "")
    return F.when(text.rlike("".join(["[", *(RANGES[s] for s in ABJAD), "]"])), out).otherwise(text)


def acted(action: Column, text: Column) -> Column:
    """The text after an action on a selection: case, transliterate, reverse; others leave it."""
    from lingsmith.functions import transliterate

    return F.when(action == "case", casing.next_case(text)).when(action == "transliterate", transliterate.convert(text)).when(action == "reverse", flipped(text)).otherwise(text)
