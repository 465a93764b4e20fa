"""Keyboard layouts as tables of keys, and texts as other layouts read them.

A layout is a row of slots in the order of the US keys; a slot has a base character and may declare a shifted one.
Between two layouts everything comes down to rules (one or two typed characters, what they become), made on the driver
and applied by the JVM's string functions: two typed characters and results of several go through private characters.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingsmith.functions import hangul, scripts
from lingsmith.functions._let import let

# The keys of the US layout by slot, and what the same keys type on other layouts. A blank is a key
# that types no single character. The last slot is the key that only ISO keyboards have.
US = "abcdefghijklmnopqrstuvwxyz" + "0123456789" + ";=,-./`[\\]'" + " "
US_SHIFTED = " " * 26 + ")!@#$%^&*(" + ":+<_>?~{|}\"" + " "
ROWS = {
    "en": "abcdefghijklmnopqrstuvwxyz" + "0123456789" + ";=,-./`[\\]'" + " ",
    "ru": "фисвуапршолдьтщзйкыегмцчня" + "0123456789" + "ж=б-ю/ёх\\ъэ" + " ",
    "uk": "фисвуапршолдьтщзйкіегмцчня" + "0123456789" + "ж=б-ю/'х\\їє" + "ґ",
    "uk-apple": "фісвуапршолдьтщзйкиегмцчня" + "0123456789" + "ж=б-ю/'х\\їє" + "ґ",
    "be": "фісвуапршолдьтўзйкыегмцчня" + "0123456789" + "ж=б-ю/ёх\\'э" + " ",
    "bg": "абцдефгхийклмнопчрстувшжъз" + "0123456789" + ";=,-./юяьщ'" + "ѝ",
    "bg-phonetic": "абцдефгхийклмнопярстужвьъз" + "0123456789" + ";=,-./чшющ'" + "ю",
    "bg-bds": "ьфъаеожгстнвпхдз,ияшкэуйщю" + "0123456789" + "м.р-лб(ц„;ч" + "ѝ",
    "mk": "абцдефгхијклмнопљрстувњџѕз" + "0123456789" + "ч=,-./`шжѓќ" + " ",
    "el": "αβψδεφγηιξκλμνοπ;ρστθωςχυζ" + "0123456789" + ";=,-./`[\\]'" + " ",
    "he": "שנבגקכעיןחלךצמםפ/רדאוה'סטז" + "0123456789" + "ף=ת-ץ.;]\\[," + "\\",
    "ar": "ش ؤيثبلاهتنمةىخحضقسفعرصءغئ" + "0123456789" + "ك=و-زظذج\\دط" + " ",
    "ka": "აბცდეფგჰიჯკლმნოპქრსტუვწხყზ" + "0123456789" + ";=,-./„[~]'" + "\\",
    "hy": "աբցդեֆգհիյկլմնօպքռստւվողըզ" + "ճէթփձջւևրչ" + ";ժ,-․/՝խշծ՛" + "»",
    "ko": "ㅁㅠㅊㅇㄷㄹㅎㅗㅑㅓㅏㅣㅡㅜㅐㅔㅂㄱㄴㅅㅕㅍㅈㅌㅛㅋ" + "0123456789" + ";=,-./`[\\]'" + " ",
}
# What Shift types where it isn't the capital letter, by US key.
SHIFTED = {
    "he": {"'": '"'},
    "ar": {"y": "إ", "h": "أ", "n": "آ", "k": "،", "p": "؛", "/": "؟"},
    "ka": {"t": "თ", "s": "შ", "r": "ღ", "c": "ჩ", "j": "ჟ", "z": "ძ", "w": "ჭ"},
    "hy": {";": "։", ",": "<", "-": "—", ".": ">", "/": "՞", "`": "՜", "'": '"', " ": "«"},
    "ko": {"q": "ㅃ", "w": "ㅉ", "e": "ㄸ", "r": "ㄲ", "t": "ㅆ", "o": "ㅒ", "p": "ㅖ"},
}
# Accents that keys add to the next letter, and keys that type two letters; (US key, shifted).
DEAD = {"el": {(";", False): "́", (";", True): "̈", ("w", True): "̈́"}}
LIGATURES = {"ar": {("b", False): "لا", ("b", True): "لآ", ("g", True): "لأ", ("t", True): "لإ"}}
# Script and language of each layout, in the order in which candidates are tried.
SCRIPT = {
    "en": "Latin", "uk": "Cyrillic", "uk-apple": "Cyrillic", "ru": "Cyrillic", "be": "Cyrillic", "bg": "Cyrillic", "bg-phonetic": "Cyrillic",
    "bg-bds": "Cyrillic", "mk": "Cyrillic", "el": "Greek", "he": "Hebrew", "ar": "Arabic", "ka": "Georgian", "hy": "Armenian", "ko": "Hangul",
}
#: First private characters for two typed characters, and for results of several.
PAIR, MANY = 0xE100, 0xE400


@dataclass(frozen=True)
class Layout:
    """base and shift by slot ("" for none); keys: slot and kind (0 plain, 1 capital, 2 shifted) of a character."""

    name: str
    base: tuple[str, ...]
    shift: tuple[str, ...]
    keys: dict[str, tuple[int, int]] = field(compare=False)
    dead: dict[tuple[int, bool], str] = field(compare=False)
    ligatures: dict[tuple[int, bool], str] = field(compare=False)

    @property
    def script(self) -> str:
        return SCRIPT[self.name]

    def char(self, slot: int, kind: int) -> str:
        """What the slot types; a shifted key without a character of its own has the capital, or nothing if there is none."""
        plain = self.base[slot]
        if not kind:
            return plain
        if self.shift[slot]:
            return self.shift[slot]
        capital = simple_upper(plain)
        return capital if kind == 1 or capital != plain else ""

    def key(self, ch: str) -> tuple[int, int] | None:
        low = simple_lower(ch)
        if low in self.keys and self.keys[low][1] == 0:
            return self.keys[low][0], int(ch != low)
        return self.keys.get(ch)

    def typed(self) -> list[str]:
        """Every single character that its keys type."""
        found = [c for c in self.base if c] + [simple_upper(c) for c in self.base if c] + [c for c in self.shift if c]
        return [c for c in dict.fromkeys(found) if self.key(c)]

    def composed(self, at: tuple[int, bool], letter: str) -> str:
        """The letter (of this layout's base row, either case) with the accent of a dead key, or ""."""
        if at not in self.dead or simple_lower(letter) not in self.base or not letter.isalpha():
            return ""
        made = unicodedata.normalize("NFC", simple_lower(letter) + self.dead[at])
        return ("" if len(made) > 1 else made) if letter == simple_lower(letter) else simple_upper(made) if len(made) == 1 else ""


def simple_lower(ch: str) -> str:
    return ch.lower() if len(ch.lower()) == 1 else ch


def simple_upper(ch: str) -> str:
    return ch.upper() if len(ch.upper()) == 1 else ch


@lru_cache(None)
def layout(name: str) -> Layout:
    base = tuple(c.strip() for c in ROWS[name])
    own = SHIFTED.get(name, {})
    symbols = name in ("en", "ko")
    shift = tuple(own.get(us) or (US_SHIFTED[i].strip() if symbols else "") for i, us in enumerate(US))
    keys: dict[str, tuple[int, int]] = {}
    for i, c in enumerate(base):
        if c:
            keys.setdefault(c, (i, 0))
    for i, c in enumerate(shift):
        if c and simple_lower(c) not in keys:
            keys.setdefault(c, (i, 2))
    at = lambda table: {(US.index(us), up): x for (us, up), x in table.get(name, {}).items()}
    return Layout(name, base, shift, keys, at(DEAD), at(LIGATURES))


def _accented(sources: tuple[Layout, ...]) -> dict[str, tuple[Layout, tuple[int, bool], str]]:
    """Characters that a source types by a dead key: the layout, the key, the letter."""
    out: dict[str, tuple[Layout, tuple[int, bool], str]] = {}
    for source in sources:
        for at in source.dead:
            for letter in source.base:
                for form in (letter, simple_upper(letter)):
                    if form and (made := source.composed(at, form)):
                        out.setdefault(made, (source, at, form))
    return out


@lru_cache(None)
def rules(sources: tuple[str, ...], to: str, ligatures_as_keys: bool = False) -> dict[str, str]:
    """What one or two characters typed on the sources become on `to`; the first source that has a key for one counts,
    for a plain key the first whose key types something there."""
    target, maps = layout(to), tuple(map(layout, sources))
    out: dict[str, str] = {}
    typed = list(dict.fromkeys(c for m in maps for c in m.typed()))
    first = {c: next(k for m in maps if (k := m.key(c))) for c in typed}
    for a in typed:
        slot, kind = first[a]
        for b in typed if (slot, kind > 0) in target.dead else ():
            if made := target.composed((slot, kind > 0), target.char(*first[b])):
                out[a + b] = made
    for made, (source, (slot, up), letter) in _accented(maps).items():
        if made in first or not source.key(letter):
            continue
        mark = target.char(slot, 0) if not up else target.shift[slot] or target.char(slot, 1)
        plain = target.char(*source.key(letter))
        if mark and plain:
            out[made] = target.composed((slot, up), plain) or mark + plain
    for c in typed:
        slot, kind = first[c]
        if (slot, kind > 0) in target.ligatures:
            out[c] = target.ligatures[slot, kind > 0]
            continue
        found = next((x for m in maps if (k := m.key(c)) and (x := target.char(*k))), c)
        if found != c:
            out[c] = found
    if ligatures_as_keys:
        for (slot, up), text in maps[0].ligatures.items():
            if x := target.char(slot, int(up)):
                out[text] = x
    return out


def apply_rules(text: Column, table: dict[str, str]) -> Column:
    pairs = [k for k in table if len(k) > 1]
    many = [k for k, v in table.items() if len(v) > 1]
    if max(len(pairs), len(many)) > 0x200:
        raise ValueError("too many rules")
    one = dict(table)
    for i, k in enumerate(pairs):
        text = F.replace(text, F.lit(k), F.lit(chr(PAIR + i)))
        one[chr(PAIR + i)] = one.pop(k)
    back = {}
    for k, v in list(one.items()):
        if len(v) != 1:
            one[k] = chr(MANY + len(back))
            back[one[k]] = v
    if one:
        text = F.translate(text, "".join(one), "".join(one.values()))
    for c, v in back.items():
        text = F.replace(text, F.lit(c), F.lit(v))
    return text


def transcode(text: Column, sources: str | tuple[str, ...], to: str, ligatures_as_keys: bool = False) -> Column:
    """The text as typed on the sources, read on `to`. Syllables of a Korean source are taken apart first; those of a
    Korean target are put together by hangul.composed (its keys stay letters here)."""
    sources = (sources,) if isinstance(sources, str) else tuple(sources)
    if "ko" in sources:
        text = hangul.decomposed(text)
    return apply_rules(text, rules(sources, to, ligatures_as_keys))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+|\s+)"), 1)


def into_script(text: Column, sources: str | tuple[str, ...], to: str) -> Column:
    """In a text of several scripts, chunks that are of the target's script for the most part stay."""
    script = SCRIPT[to]
    moved = F.array_join(F.transform(_chunks(text), lambda c: F.when(scripts.dominant(c) == script, c).otherwise(transcode(c, sources, to))), "")
    return F.when(scripts.mixed(text), moved).otherwise(transcode(text, sources, to))


def read_by_rules(text: str, table: dict[str, str]) -> str:
    """apply_rules for a string on the driver or in a worker."""
    pairs = [k for k in table if len(k) > 1]
    if not pairs:
        return text.translate({ord(k): v for k, v in table.items()})
    pattern = re.compile("|".join(map(re.escape, sorted(pairs, key=len, reverse=True))) + "|.", re.S)
    return pattern.sub(lambda m: table.get(m[0], m[0]), text)


def kept_apart(text: str, spans: list[tuple[int, int]], table: dict[str, str], script: str) -> str:
    """The text read by the table but for spans (start, end) and, if it is of several scripts, chunks of the target's."""
    mask = bytearray(len(text))
    spans = list(spans)
    if len({s for c in set(text) if (s := scripts.script_of(c))}) > 1:
        spans += [m.span() for m in re.finditer(r"\S+", text) if scripts.dominant_of(m[0]) == script]
    for start, end in spans:
        start, end = max(0, start), min(len(text), end)
        mask[start:end] = b"\1" * (end - start)
    out, at = [], 0
    for m in re.finditer(rb"\x00+|\x01+", bytes(mask)):
        piece = text[m.start() : m.end()]
        out.append(piece if m[0][0] else "".join(x if x.isspace() else read_by_rules(x, table) for x in re.findall(r"\S+|\s+", piece)))
        at = m.end()
    return "".join(out) + text[at:]


def chunk_spans(text: Column, every: int) -> Column:
    """Spans (start, end) of every n-th run without white space, the first included."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def run(batch):  # type: ignore[no-untyped-def]
        return batch.map(lambda t: None if t is None else [{"start": m.start(), "end": m.end()} for i, m in enumerate(re.finditer(r"\S+", t)) if i % every == 0])

    return run(text)


def keeping(text: Column, spans: Column, sources: str | tuple[str, ...], to: str) -> Column:
    """into_script with spans (start, end; from 0, in characters) kept as they are; what lies between is read piece by
    piece. Spans of any places need the text as a row of characters, so this runs in Arrow batches."""
    sources = (sources,) if isinstance(sources, str) else tuple(sources)
    table, script = rules(sources, to), SCRIPT[to]

    @F.pandas_udf("string")
    def run(texts, spans):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series([None if t is None else kept_apart(t, [(x["start"], x["end"]) for x in (s if s is not None else ())], table, script) for t, s in zip(texts, spans)], index=texts.index, dtype=object)

    return run(text, spans)


def mistyped_keys(source: str, to: str) -> str:
    """Characters that are no letters of the target's script but sit on keys that type one of its letters there."""
    a, b = layout(source), layout(to)
    return "".join(c for c in a.typed() if not scripts.letter_of(c, b.script) and scripts.letter_of(b.base[a.key(c)[0]], b.script) and a.keys.get(simple_lower(c), (0, 2))[1] == 0)


def dimension() -> list[tuple[str, str, int, str, str, str]]:
    """(layout, script, slot, us, base, shifted) of every key that types something."""
    return [(n, SCRIPT[n], i, US[i].strip(), layout(n).base[i], layout(n).shift[i]) for n in ROWS for i in range(len(US)) if layout(n).base[i] or layout(n).shift[i]]


def letter_digits(names: list[str]) -> str:
    """Digits whose key types a letter on one of the layouts."""
    return "".join(d for d in "0123456789" if any(layout(n).base[US.index(d)].isalpha() for n in names))


@lru_cache(None)
def oem_keys() -> str:
    """US keys, neither letters nor digits, that type a letter or an accent on a layout of letters (Armenian and Korean aside)."""
    out = []
    for n in ROWS:
        if n in ("en", "hy", "ko"):
            continue
        for i, us in enumerate(US):
            if us.isalnum() or us == " ":
                continue
            if scripts.script_of(layout(n).base[i]) or (i, False) in layout(n).dead:
                out.append(us)
            if (i, True) in layout(n).dead:
                out.append(US_SHIFTED[i])
    return "".join(sorted(set(out)))


def shift_letter_keys() -> str:
    """Capital letters of the US keys whose shift types a letter of its own in a script without capitals (Korean aside)."""
    return "".join(sorted({us.upper() for n in ("he", "ar", "ka") for i, us in enumerate(US) if us.isalpha() and scripts.script_of(layout(n).shift[i])}))


def candidates(script: Column, mixed: Column, preferred: str, mistyped: dict[str, Column] | None = None) -> Column:
    """Layouts in the order in which a plain switch tries them: in mixed texts those of the text's script, the preferred
    one first; then those of other scripts, the preferred one first; last those of the script with a mistyped key."""
    # the script is asked for by every rule and may be a count of the whole text
    return let(F.struct(script.alias("script"), mixed.alias("mixed")), lambda x: _in_order(x["script"], x["mixed"], preferred, mistyped))


def _in_order(script: Column, mixed: Column, preferred: str, mistyped: dict[str, Column] | None) -> Column:
    names = list(SCRIPT)
    own = lambda n: script == SCRIPT[n]
    part = lambda rule: [F.when(rule(n), F.lit(n)) for n in names]
    order = part(lambda n: mixed & own(n) & F.lit(n == preferred)) + part(lambda n: mixed & own(n))
    order += part(lambda n: ~F.coalesce(own(n), F.lit(False)) & F.lit(n == preferred)) + part(lambda n: ~F.coalesce(own(n), F.lit(False)))
    order += [F.when(own(n) & hit, F.lit(n)) for n, hit in (mistyped or {}).items()]
    return F.array_distinct(F.array_compact(F.array(*order)))


def plain_switch(text: Column, active: str, installed: list[str], preferred: str) -> Column:
    """The text on the first layout in that order that changes it; the majority script says what it was typed on."""
    out = []
    for source in installed:
        script = SCRIPT[source]
        others = [n for n in installed if n != source]
        first = (scripts.majority(text) == script) if source != active else F.coalesce(scripts.majority(text), F.lit(script)) == script
        order = sorted(others, key=lambda n: (SCRIPT[n] == script, n != preferred, installed.index(n)))
        same = [n for n in others if SCRIPT[n] == script]
        found = [into_script(text, (source, *others), n) for n in order if SCRIPT[n] != script]
        found += [F.when(text.rlike("[" + re.escape(mistyped_keys(source, n)) + "]"), into_script(text, (source, *others), n)) for n in same if mistyped_keys(source, n)]
        mixed_first = [F.when(scripts.mixed(text), into_script(text, (source, *others), n)) for n in sorted(same, key=lambda n: n != preferred)]
        steps = [F.when(x != text, x) for x in mixed_first + found]
        out.append(F.when(first, F.coalesce(*steps, text) if steps else text))
    return F.coalesce(*out, text)
