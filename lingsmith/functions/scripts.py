"""Scripts of a text: letters by script, the dominant script, mixed words."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingsmith.functions._let import let

# Letter ranges of each script, in the order in which ties are settled.
RANGES = {
    "Latin": r"a-zA-Z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}",
    "Cyrillic": r"\x{0400}-\x{04FF}",
    "Greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "Hebrew": r"\x{05D0}-\x{05EA}",
    "Arabic": r"\x{0620}-\x{064A}",
    "Georgian": r"\x{10D0}-\x{10FF}",
    "Armenian": r"\x{0531}-\x{0587}",
    "Hangul": r"\x{AC00}-\x{D7A3}",
}


def letters(text: Column, script: str) -> Column:
    """Letters of a script in a text; whole runs of other characters go at once."""
    return F.length(F.regexp_replace(text, f"[^{RANGES[script]}]++", ""))


_CLASS = {s: re.compile(f"[{re.sub(r'.x.([0-9A-F]{4}).', lambda m: chr(int(m[1], 16)), r)}]") for s, r in RANGES.items()}


def letter_of(ch: str, script: str) -> bool:
    """Whether a character, on the driver, is a letter of the script (letters of Korean keys too)."""
    return bool(ch and (_CLASS[script].fullmatch(ch) or script == "Hangul" and "\u3131" <= ch <= "\u3163"))


def script_of(ch: str) -> str | None:
    return next((s for s in RANGES if letter_of(ch, s)), None)


def dominant_of(text: str) -> str | None:
    """dominant, for a string on the driver or in a worker."""
    n = {s: len(c.findall(text)) for s, c in _CLASS.items()}
    best = max(n, key=n.get)  # type: ignore[arg-type]
    return best if n[best] else None


def dominant(text: Column) -> Column:
    """The script with most letters; the first in order on ties; null without letters."""
    order = {s: -i for i, s in enumerate(RANGES)}
    n = lambda s, rest: letters(text if s == "Latin" else rest, s)
    found = lambda rest: F.array(*[F.struct(n(s, rest).alias("n"), F.lit(order[s]).alias("at"), F.lit(s).alias("s")) for s in RANGES])
    # of ASCII only Latin has letters, so the others are looked for in what lies beyond it
    best = let(F.regexp_replace(text, r"[\x{00}-\x{7F}]++", ""), lambda rest: F.array_max(found(rest)))
    return let(best, lambda best: F.when(best["n"] > 0, best["s"]))


def scripts_seen(text: Column) -> Column:
    return sum((text.rlike(f"[{r}]").cast("int") for r in RANGES.values()), F.lit(0))



def mixed(text: Column) -> Column:
    """Letters of two scripts or more."""
    return scripts_seen(text) > 1


ABJAD = ("Hebrew", "Arabic")

# Vowels of scripts that write them, and marks left out or unified in lookups.
VOWELS = {
    "Cyrillic": "аеёиоуыэюяіїєўъѝѐ",
    "Greek": "αεηιουωάέήίόύώϊϋΐΰ",
    "Georgian": "აეიოუ",
    "Armenian": "աեէըիոօ",
}


def _latin() -> list[str]:
    return [chr(c) for a, b in ((0xC0, 0x24F), (0x1E00, 0x1EFF)) for c in range(a, b + 1) if chr(c).isalpha()]


def accents() -> tuple[str, str]:
    """Latin and Greek letters with marks, and their bare letters; from the Unicode tables."""
    both = [(c, b) for c in _latin() + [chr(c) for c in range(0x386, 0x3CF)] if (b := unicodedata.normalize("NFD", c)[0]) != c and b.isalpha()]
    return "".join(c for c, _ in both), "".join(b for _, b in both)


def _vowels(script: str) -> str:
    if script == "Latin":
        return "aeiouyıøæœơư" + "".join(c for c in _latin() if c == c.lower() and unicodedata.normalize("NFD", c)[0] in "aeiouyıøæœơư")
    return VOWELS.get(script, "")


def bare(text: Column) -> Column:
    """Without accents."""
    return F.translate(text, *accents())


def majority(text: Column) -> Column:
    """The script with most letters; on ties the one that comes first in the text; null without letters."""
    found = [F.struct(letters(text, s).alias("n"), (-F.length(F.regexp_extract(text, f"(?s)^([^{r}]*)", 1))).alias("at"), F.lit(s).alias("s")) for s, r in RANGES.items()]
    return let(F.array_max(F.array(*found)), lambda best: F.when(best["n"] > 0, best["s"]))


def is_word_of(word: Column, script: str) -> Column:
    """Begins with a letter of the script, holds nothing else but marks between its letters."""
    r = RANGES[script]
    inner = {"Cyrillic": "['’ʼ]", "Hebrew": "[\"'׳״]"}.get(script)
    skip = {"Hebrew": r"\x{0591}-\x{05AF}\x{05B0}-\x{05C7}", "Arabic": r"\x{064B}-\x{065F}\x{0670}\x{0640}", "Armenian": "՛՜՞"}.get(script, "")
    body = f"[{r}{skip}]" + (f"|{inner}(?=[{r}])" if inner else "")
    return word.rlike(f"^[{r}](?:{body})*$")


def within(word: Column, alphabet: str) -> Column:
    """At least one letter, and every letter in the alphabet."""
    low = F.lower(word)
    return low.rlike(r"\p{L}") & ~low.rlike(f"[\\p{{L}}&&[^{alphabet}]]")


def possible(word: Column, script: str) -> Column:
    """Spelled as the script allows: final forms at the end, signs not doubled; judged by runs of letters."""
    r = RANGES[script]
    bad = {
        "Hebrew": f"[ךםןףץ](?=[{r}])",
        "Arabic": f"ة(?=[{r}])|ى(?=[{r}])(?!ء)",
        "Greek": f"ς(?=[{r}])",
        "Cyrillic": f"(?iu)(?<![{r}])[ыь](?=[{r}])|[ьъы][ьъы]",
    }.get(script)
    return ~word.rlike(bad) if bad else F.lit(True)


def naturalness(word: Column, script: str = "Latin") -> Column:
    """How much a word looks like one by its share of vowels and runs of consonants, 0..1; abjads score 0.5."""
    r, v = RANGES[script], _vowels(script)
    n = letters(word, script)
    if script in ABJAD:
        score = F.lit(0.5)
    else:
        low = F.lower(word)
        vowels = F.length(F.regexp_replace(low, f"[^{v}]", "")) if v else F.lit(0)
        share = vowels / F.greatest(n, F.lit(1))
        drift = F.when(share < 0.2, 0.2 - share).when(share > 0.6, share - 0.6).otherwise(0.0)
        first = F.when((n >= 3) & (vowels == 0), 0.05).otherwise(F.greatest(F.lit(0.1), 1.0 - drift * 2.0))
        runs = F.transform(F.regexp_extract_all(F.regexp_replace(low, f"[{v}]" if v else r"\x{0}", " "), F.lit(f"([{r}]+)"), 1), F.length)
        run = F.coalesce(F.array_max(runs), F.lit(0))
        score = first * F.when(run >= 5, 0.2).when(run == 4, 0.6).otherwise(1.0)
    return F.when(n == 0, 0.0).when(possible(word, script), score).otherwise(F.least(score, F.lit(0.05)))


def folded(word: Column, script: str) -> Column:
    """The form under which a word is looked up."""
    w = F.lower(word)
    if script == "Cyrillic":
        return F.regexp_replace(w, "['’ʼ]", "")
    if script == "Hebrew":
        return F.translate(F.regexp_replace(w, r"[\x{0591}-\x{05AF}\x{05B0}-\x{05C7}]", ""), "׳״", "'\"")
    if script == "Arabic":
        w = F.translate(F.regexp_replace(w, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", ""), "أإآ", "ااا")
        return F.regexp_replace(w, "(.)ة$", "$1ه")
    if script == "Armenian":
        return F.replace(F.regexp_replace(w, "[՛՜՞]", ""), F.lit("և"), F.lit("եւ"))
    return w


def trimmed(text: Column, script: str) -> Column:
    """Without what stands before its first and after its last letter of the script."""
    r = RANGES[script]
    return F.regexp_replace(text, f"(?s)^[^{r}]+|[^{r}]+$", "")


def like_case(word: Column, original: Column) -> Column:
    """With a capital if the original has one."""
    return F.when(original.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))).otherwise(word)


#: Scripts whose layouts follow Latin sounds, and those without capitals.
PHONETIC = ("Georgian", "Armenian", "Hangul")
CASELESS = ("Hebrew", "Arabic", "Georgian", "Hangul")


def is_blind(script: str) -> bool:
    """Whether a score of letters tells nothing of the script."""
    return script in ABJAD or script in PHONETIC


def is_blind_pair(a: str, b: str) -> bool:
    return a in ABJAD or b in ABJAD or "Latin" in (a, b) and (a in PHONETIC or b in PHONETIC)


def latin_vowels() -> str:
    return _vowels("Latin")


def marks_folded(word: Column, script: str) -> Column:
    """Without marks that a script's words may go without; marks inside words as one plain sign or the other."""
    if script == "Cyrillic":
        return F.translate(word, "’ʼ", "''")
    if script == "Hebrew":
        return F.translate(F.regexp_replace(word, r"[\x{0591}-\x{05AF}\x{05B0}-\x{05C7}]", ""), "׳״", "'\"")
    if script == "Arabic":
        return F.regexp_replace(word, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", "")
    return F.regexp_replace(word, "[՛՜՞]", "") if script == "Armenian" else word


def cedilla_folded(word: Column, romanian: Column) -> Column:
    return F.when(romanian, F.translate(word, "şţŞŢ", "șțȘȚ")).otherwise(word)
