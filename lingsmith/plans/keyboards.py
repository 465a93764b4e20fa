"""Keyboard layouts: their keys, texts read on other layouts, layouts told from keys, words that keys could mean."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from lingsmith.functions import hangul, scripts
from lingsmith.functions import keyboards as B
from lingsmith.functions import text as X
from lingsmith.operators import lexicon as L
from lingsmith.plans._registry import WORDS, query, t

_R = scripts.RANGES


def _docs(spark, d):
    return t(spark, d, "documents")


#: White space of Unicode, for patterns of RE2.
_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_PARTS = f"'([^{_WS}]+|[{_WS}]+)'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DIM = "(select * from (values " + ", ".join(f"({_text(n)}, {_text(s)}, {i}, {_text(us)}, {_text(b)}, {_text(up)})" for n, s, i, us, b, up in B.dimension()) + ") v(layout, script, slot, us, base, shift))"
_ORDER = "(select * from (values " + ", ".join(f"({_text(n)}, {_text(s)}, {i})" for i, (n, s) in enumerate(B.SCRIPT.items())) + ") v(layout, script, pos))"


def _keys(spark):
    return spark.createDataFrame(B.dimension(), "layout string, script string, slot int, us string, base string, shift string")


def _layouts(spark):
    return spark.createDataFrame([(n, s, i) for i, (n, s) in enumerate(B.SCRIPT.items())], "layout string, script string, pos int")


def _read(text: str, table: dict[str, str]) -> str:
    """Piece by piece, the longest rule first."""
    pieces = "|".join(re.escape(k) for k in sorted(table, key=len, reverse=True))
    known = "map {" + ", ".join(f"{_text(a)}: {_text(b)}" for a, b in table.items()) + "}"
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({text}, {_text('(?s)(' + pieces + '|.)')}), lambda x: coalesce({known}[x], x)), ''), '')"


def _dominant(c: str) -> str:
    n = lambda s: f"length(regexp_replace({c}, '[^{_R[s]}]', '', 'g'))"
    top = f"greatest({', '.join(map(n, _R))})"
    return f"case when {top} = 0 then null " + " ".join(f"when {n(s)} = {top} then '{s}'" for s in _R) + " end"


_CHARS = "(select ch, count(*) as n from (select unnest(regexp_extract_all(text, '(?s).')) as ch from documents) group by 1)"


def _chars(spark, d):
    return _docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("(?s)(.)"), 1)).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def _typed(spark):
    """(layout, ch, slot, kind) of every character that a key types, from the layouts' own tables: some 1,000 rows."""
    rows = [(n, c, *B.layout(n).key(c)) for n in B.ROWS for c in B.layout(n).typed()]
    return F.broadcast(spark.createDataFrame(rows, "layout string, ch string, slot int, kind int"))


_KEYED = f"""(select layout, ch, n, coalesce(plain, shifted) as slot, case when plain is null then 2 when ch <> lower(ch) then 1 else 0 end as kind
from (select c.ch, c.n, k.layout, min(slot) filter (where base = lower(c.ch) and base <> '') as plain, min(slot) filter (where shift = c.ch and shift <> '') as shifted from {_CHARS} c, {_DIM} k group by all) where coalesce(plain, shifted) is not null)"""


@query(f"select layout, slot, kind, sum(n)::bigint as n from {_KEYED} group by all")
def l01_keys_pressed(spark, d):
    """How often each key of each layout is pressed in typing the documents' characters."""
    return _chars(spark, d).join(_typed(spark), "ch").groupBy("layout", "slot", "kind").agg(F.sum("n").alias("n"))


@query(f"""select e.ch, k.layout, case when kind = 0 then base when shift <> '' then shift when kind = 1 or upper(base) <> base then upper(base) else '' end as typed
from {_KEYED} e join {_DIM} k using (slot) where e.layout = 'en' and k.layout <> 'en'""")
def l02_same_key_elsewhere(spark, d):
    """Each character of the documents that the US layout types, as the same key on the other layouts types it."""
    rows = [(slot, kind, n, B.layout(n).char(slot, kind)) for n in B.ROWS if n != "en" for slot in range(len(B.US)) for kind in (0, 1, 2) if B.layout(n).base[slot] or B.layout(n).shift[slot]]
    keys = F.broadcast(spark.createDataFrame(rows, "slot int, kind int, layout string, typed string"))
    return _chars(spark, d).join(_typed(spark).filter("layout = 'en'").drop("layout"), "ch").join(keys, ["slot", "kind"]).select("ch", "layout", "typed")


_TWO = f"case when doc_id % 2 = 0 then {_read('text', B.rules(('en',), 'ru'))} else {_read('text', B.rules(('en',), 'uk'))} end"


@query(f"select doc_id, {_read('typed', B.rules(('uk', 'ru'), 'en'))} as text from (select doc_id, {_TWO} as typed from documents)")
def l04_two_sources(spark, d):
    """Texts typed on either of two layouts: the first that has a key for a character counts."""
    x = F.col("text")
    typed = F.when(F.col("doc_id") % 2 == 0, B.transcode(x, "en", "ru")).otherwise(B.transcode(x, "en", "uk"))
    return _docs(spark, d).select("doc_id", B.transcode(typed, ("uk", "ru"), "en").alias("text"))


_ACCENTED = "regexp_replace(regexp_replace(text, '([aeio])', ';\\1', 'g'), 'y', ':y', 'g')"


@query(f"select doc_id, {_read(_ACCENTED, B.rules(('en',), 'el'))} as text from documents")
def l05_dead_keys(spark, d):
    """Keys of an accent before keys of a letter become the accented letter."""
    x = F.regexp_replace(F.regexp_replace("text", "([aeio])", ";$1"), "y", ":y")
    return _docs(spark, d).select("doc_id", B.transcode(x, "en", "el").alias("text"))


@query(f"select doc_id, {_read(_read(_ACCENTED, B.rules(('en',), 'el')), B.rules(('el',), 'en'))} as text from documents")
def l06_accents_as_keys(spark, d):
    """Accented letters as the two keys that type them."""
    x = F.regexp_replace(F.regexp_replace("text", "([aeio])", ";$1"), "y", ":y")
    return _docs(spark, d).select("doc_id", B.transcode(B.transcode(x, "en", "el"), "el", "en").alias("text"))


@query(f"select doc_id, {_read('text', B.rules(('en',), 'ar'))} as text from documents")
def l07_ligatures(spark, d):
    """A key that types two letters gives both."""
    return _docs(spark, d).select("doc_id", B.transcode(F.col("text"), "en", "ar").alias("text"))


@query(f"select doc_id, {_read(_read('text', B.rules(('en',), 'ar')), B.rules(('ar',), 'en', True))} as text from documents")
def l08_ligatures_as_keys(spark, d):
    """Two letters that one key types read as that key."""
    return _docs(spark, d).select("doc_id", B.transcode(B.transcode(F.col("text"), "en", "ar"), "ar", "en", True).alias("text"))


@query(f"select us, up, base as letter, nfc_normalize(base || mark) as composed from {_DIM}, (values (';', false, chr(769)), (';', true, chr(776)), ('w', true, chr(776) || chr(769))) m(us, up, mark) where layout = 'el' and length(nfc_normalize(base || mark)) = 1 and regexp_matches(base, '\\p{{L}}')".replace("select us, up", "select m.us, up"))
def l09_compositions(spark, d):
    """Letters that each dead key of the Greek layout composes."""
    g = B.layout("el")
    rows = [(B.US[slot], up, c, g.composed((slot, up), c)) for slot, up in g.dead for c in g.base if c and g.composed((slot, up), c)]
    return spark.createDataFrame(rows, "us string, up boolean, letter string, composed string")


def _half(col: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({col}, {_PARTS}), lambda c, i: case when i % 4 = 1 then {_read('c', B.rules(('en',), 'uk'))} else c end), '')"


def _half_typed(x):
    parts = F.regexp_extract_all(x, F.lit(r"(?U)(\S+|\s+)"), 1)
    return F.array_join(F.transform(parts, lambda c, i: F.when(i % 4 == 0, B.transcode(c, "en", "uk")).otherwise(c)), "")


_INTO = f"array_to_string(list_transform(regexp_extract_all(x, {_PARTS}), lambda c: case when {_dominant('c')} = 'Cyrillic' then c else {_read('c', B.rules(('en',), 'uk'))} end), '')"


@query(f"select doc_id, {_INTO} as text from (select doc_id, {_half('text')} as x from documents)")
def l10_into_script(spark, d):
    """Texts typed half on one layout: what is in the target's script already stays."""
    x = _half_typed(F.col("text"))
    return _docs(spark, d).select("doc_id", B.into_script(x, "en", "uk").alias("text"))


@query(f"""select doc_id, array_to_string(list_transform(regexp_extract_all(x, {_PARTS}), lambda c, i: case when (i - case when regexp_matches(x, '^[{_WS}]') then 1 else 0 end) % 6 = 1 then c else {_read('c', B.rules(('en',), 'el'))} end), '') as text
from (select doc_id, text as x from documents)""")
def l11_spans_kept(spark, d):
    """Every third chunk kept as it is, the rest read on the Greek layout."""
    x = F.col("text")
    spans = B.chunk_spans(x, 3)
    return _docs(spark, d).select("doc_id", B.keeping(x, spans, "en", "el").alias("text"))


@query(f"select lang, count(*) as n from (select lang, unnest(regexp_extract_all(text, '[^{_WS}]+')) as w from documents) where regexp_matches(w, {_text('[' + re.escape(B.mistyped_keys('en', 'he')) + ']')}) group by 1")
def l12_mistyped_keys(spark, d):
    """Chunks with a key that types no letter here but one on the Hebrew layout."""
    return _docs(spark, d).select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"(?U)(\S+)"), 1)).alias("w")).filter(F.col("w").rlike("[" + re.escape(B.mistyped_keys("en", "he")) + "]")).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"select word, {_read('word', B.rules(('en',), 'ko'))} as keys from (select distinct word from {WORDS})")
def l13_hangul_keys(spark, d):
    """Words read on the Korean layout, put together as syllables and taken apart again: the keys they were typed by."""
    return _hangul(spark, d).select("word", hangul.decomposed(F.col("syllables")).alias("keys"))


@query(None)
def l14_hangul_syllables(spark, d):
    return _hangul(spark, d).select("word", "syllables")


def _hangul(spark, d):
    words = L.word_counts(_docs(spark, d)).select("word").distinct()
    return words.select("word", hangul.composed_column(B.transcode(F.col("word"), "en", "ko")).alias("syllables"))


@query(f"select layout, script, count(*) as keys, sum((regexp_matches(base, '\\p{{L}}'))::int)::bigint as letters, sum((shift <> '')::int)::bigint as shifted, string_agg(base, '' order by slot) as row from {_DIM} group by all")
def l15_bundled_layouts(spark, d):
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "base"))), lambda x: x["base"]), "")
    return _keys(spark).groupBy("layout", "script").agg(F.count("*").alias("keys"), F.sum(F.col("base").rlike(r"\p{L}").cast("int")).alias("letters"), F.sum((F.col("shift") != "").cast("int")).alias("shifted"), row.alias("row"))


@query(f"select s.script, l.layout from (select distinct script from {_ORDER}) s, {_ORDER} l where l.script <> s.script")
def l16_other_scripts(spark, d):
    """The layouts that a text in a script may have been meant for: all of other scripts."""
    rows = _layouts(spark)
    known = rows.groupBy().agg(F.collect_set("script").alias("all"))  # eight scripts
    return rows.select("script", "layout").join(F.broadcast(known)).select(F.explode(F.array_except("all", F.array("script"))).alias("script"), "layout")


@query(f"select script, arg_min(layout, pos) as fallback, count(*) as layouts from {_ORDER} group by 1")
def l17_fallback_layouts(spark, d):
    return _layouts(spark).groupBy("script").agg(F.min_by("layout", "pos").alias("fallback"), F.count("*").alias("layouts"))


_INSTALLED = "(select user_id, event_id, case event_type when 'click' then 'uk' when 'view' then 'en' when 'error' then 'el' when 'purchase' then 'ru' end as layout from events)"


def _installed(spark, d):
    kind = F.col("event_type")
    named = F.when(kind == "click", "uk").when(kind == "view", "en").when(kind == "error", "el").when(kind == "purchase", "ru")
    return t(spark, d, "events").select("user_id", "event_id", named.alias("layout"))


@query(f"select user_id, layout, row_number() over (partition by user_id order by first) as pos from (select user_id, layout, min(event_id) as first from {_INSTALLED} where layout is not null group by all)")
def l18_installed_candidates(spark, d):
    """Layouts with a script as they come, each once: the first counts."""
    first = _installed(spark, d).filter("layout is not null").groupBy("user_id", "layout").agg(F.min("event_id").alias("first"))
    return first.select("user_id", "layout", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).cast("long").alias("pos"))


@query(f"select a.layout as layout, b.layout as other, count(*) as differing from {_DIM} a join {_DIM} b on a.script = b.script and a.slot = b.slot and a.layout < b.layout where a.base <> b.base group by all")
def l19_layout_variants(spark, d):
    """On how many keys two layouts of one script differ."""
    k = _keys(spark).select("layout", "script", "slot", "base")
    both = k.join(k.toDF("other", "script", "slot", "b"), ["script", "slot"]).filter((F.col("layout") < F.col("other")) & (F.col("base") != F.col("b")))
    return both.groupBy("layout", "other").agg(F.count("*").alias("differing"))


_LANG = "case when ends_with(layout, 'apple') or ends_with(layout, 'phonetic') or ends_with(layout, 'bds') then string_split(layout, '-')[1] else layout end"
#: Keyboards seen: a Cyrillic layout with every third letter key lost for some.
_SEEN = f"(select layout as keyboard, case when layout in ('mk', 'bg') and slot % 3 <> 0 then '' else base end as ch, slot from {_DIM} where script = 'Cyrillic' or layout = 'el')"
_AGREE = f"(select s.keyboard, {_LANG} as code, max(n) as best from (select s.keyboard, k.layout, count(*) filter (where s.ch <> '' and s.ch = k.base) as n from {_SEEN} s join {_DIM} k using (slot) where k.script = 'Cyrillic' group by all) s group by all)".replace("s.keyboard, {", "keyboard, {").replace("(select s.keyboard, case", "(select keyboard, case")


def _seen(spark):
    lost = F.col("layout").isin("mk", "bg") & (F.col("slot") % 3 != 0)
    return _keys(spark).filter("script = 'Cyrillic' or layout = 'el'").select(F.col("layout").alias("keyboard"), F.when(lost, "").otherwise(F.col("base")).alias("ch"), "slot")


def _agreement(spark):
    k = _keys(spark).filter("script = 'Cyrillic'").select("layout", "slot", "base")
    n = _seen(spark).join(k, "slot").groupBy("keyboard", "layout").agg(F.count_if((F.col("ch") != "") & (F.col("ch") == F.col("base"))).alias("n"))
    return n.groupBy("keyboard", F.substring_index("layout", "-", 1).alias("code")).agg(F.max("n").alias("best"))


@query(f"select keyboard, code, best from {_AGREE}")
def a21_slot_agreement(spark, d):
    """Keys that a keyboard shares with the best layout of each language."""
    return _agreement(spark)


_TOLD = f"(select keyboard, max(best) as top, arg_max(code, best) as code, list(best order by best desc)[2] as second from {_AGREE} group by 1)"


def _told(spark):
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("m"), "code")))
    a = _agreement(spark).groupBy("keyboard").agg(ranked.alias("r"))
    top, second = -F.get("r", F.lit(0))["m"], -F.get("r", F.lit(1))["m"]
    return a.select("keyboard", F.when((top >= 16) & (top - second >= 2), F.get("r", F.lit(0))["code"]).alias("code"))


@query(f"select keyboard, case when top >= 16 and top - second >= 2 then code end as code from {_TOLD}")
def s14_language_of_keys(spark, d):
    """The language of a Cyrillic keyboard: 16 keys shared at least, two more than with any other."""
    return _told(spark)


@query(f"select keyboard, coalesce(case when keyboard in ('ru', 'bg') then keyboard end, case when top >= 16 and top - second >= 2 then code end) as code from {_TOLD}")
def l20_layout_language(spark, d):
    """The code that the system gives, else the one told from the keys."""
    given = F.when(F.col("keyboard").isin("ru", "bg"), F.col("keyboard"))
    return _told(spark).select("keyboard", F.coalesce(given, "code").alias("code"))


@query(f"select slot, base, shift from {_DIM} where layout = 'en' and shift <> '' and not regexp_matches(base, '\\p{{L}}') and not regexp_matches(shift, '\\p{{L}}')")
def l21_shifted_symbols(spark, d):
    """Shifted characters where neither they nor the plain ones are letters."""
    k = _keys(spark).filter("layout = 'en' and shift <> ''")
    return k.filter(~F.col("base").rlike(r"\p{L}") & ~F.col("shift").rlike(r"\p{L}")).select("slot", "base", "shift")


_TAGS = ["en-US", "uk-UA", "ru", "pt-BR", "el-GR", "he", "ka-GE", "xx"]


@query(f"select doc_id, case when code in ('en', 'ru', 'uk', 'be', 'bg', 'mk', 'el', 'he', 'ar', 'ka', 'hy', 'ko') then code end as layout from (select doc_id, string_split([{', '.join(map(_text, _TAGS))}][doc_id % 8 + 1], '-')[1] as code from documents)")
def s13_layout_of_language(spark, d):
    code = F.substring_index(F.get(F.array(*map(F.lit, _TAGS)), (F.col("doc_id") % 8).cast("int")), "-", 1)
    known = [n for n in B.SCRIPT if "-" not in n]
    return _docs(spark, d).select("doc_id", F.when(code.isin(known), code).alias("layout"))


@query("select layout, string_agg(us, '' order by us) as digits from " + _DIM + r" where regexp_matches(us, '^[0-9]$') and regexp_matches(base, '\p{L}') group by 1")
def f09_letter_digits(spark, d):
    """Digits whose keys type letters."""
    k = _keys(spark).filter(F.col("us").rlike("^[0-9]$") & F.col("base").rlike(r"\p{L}"))
    return k.groupBy("layout").agg(F.array_join(F.array_sort(F.collect_list("us")), "").alias("digits"))


_ANY = "".join(_R.values())


@query(f"select distinct us as key from (select us, base from {_DIM} where layout not in ('en', 'hy', 'ko') and us <> '' and not regexp_matches(us, '[a-z0-9]') and regexp_matches(base, '[{_ANY}]') union all select unnest([';', ':']), '')")
def f11_oem_letter_keys(spark, d):
    """Keys of signs that type a letter or an accent on some layout."""
    return spark.createDataFrame([(c,) for c in B.oem_keys()], "key string")


@query(f"select layout, count(*) as words from (select word, unnest({list(B.ROWS)}) as layout from (select distinct word from {WORDS})) w where not exists (select 1 from (select unnest(regexp_extract_all(w.word, '.')) as ch) c where c.ch not in (select ch from (select layout, unnest([base, upper(base), shift]) as ch from {_DIM}) k where k.layout = w.layout and ch <> '')) group by 1".replace("not exists (select 1 from (select unnest(regexp_extract_all(w.word, '.')) as ch) c where c.ch not in (select ch from (select layout, unnest([base, upper(base), shift]) as ch from " + _DIM + ") k where k.layout = w.layout and ch <> ''))", "translate(word, " + "case layout " + " ".join(f"when {_text(n)} then {_text(''.join(B.layout(n).typed()))}" for n in B.ROWS) + " end, '') = ''"))
def f14_typable_words(spark, d):
    """Words of the documents that each layout can type."""
    words = L.word_counts(_docs(spark, d)).select("word").distinct()
    ok = [F.when(F.translate("word", "".join(B.layout(n).typed()), "") == "", F.lit(n)) for n in B.ROWS]
    return words.select(F.explode(F.array_compact(F.array(*ok))).alias("layout")).groupBy("layout").agg(F.count("*").alias("words"))


_CHUNK = r"(select doc_id, unnest(regexp_extract_all(text, '[^ \t\r\n]+')) as w from documents)"
_OEM = re.escape(B.oem_keys())
_UP = B.shift_letter_keys()
_CORE = r"regexp_replace(w, '^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$', '', 'g')"
_ELIGIBLE = (
    f"(length(core) >= 3 and regexp_matches(core, {_text(rf'^[\p{{L}}{_OEM}]*$')}) and regexp_matches(core, '[\\p{{Ll}}\\p{{Lo}}\\p{{Lm}}\\p{{Lt}}]') "
    rf"and (not regexp_matches(substr(core, 2), {_text(rf'[^\P{{Lu}}{_UP}]')}) or regexp_matches(core, '^\p{{Ll}}\p{{Lu}}{{4,}}$') or (regexp_matches(core, '^\p{{Lu}}{{2}}\p{{Ll}}+$') and not (ends_with(core, 's') and length(core) = 3))))"
)


def _chunk_rows(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([^ \t\r\n]+)"), 1)).alias("w"))


@query(f"select doc_id, count(*) as chunks, sum({_ELIGIBLE}::int)::bigint as eligible from (select doc_id, {_CORE} as core from {_CHUNK}) group by 1")
def f08_auto_eligible(spark, d):
    """Chunks that may be corrected without being asked for, on a line that has no direction yet."""
    return _chunk_rows(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(X.auto_eligible(F.col("w"), B.oem_keys(), B.shift_letter_keys()).cast("int")).alias("eligible"))


@query(f"select doc_id, sum(regexp_matches(w, '[0-9]')::int)::bigint as keys_only, sum((not regexp_matches(w, '[0-9]') or not regexp_matches({_read('w', B.rules(('en',), 'hy'))}, '[0-9]'))::int)::bigint as reads_through from {_CHUNK} group by 1")
def f10_digit_words(spark, d):
    """Words with digits may only switch layout, and only if their digit keys read as letters too."""
    digit = F.col("w").rlike("[0-9]")
    through = ~digit | ~B.transcode(F.col("w"), "en", "hy").rlike("[0-9]")
    return _chunk_rows(spark, d).groupBy("doc_id").agg(F.sum(digit.cast("int")).alias("keys_only"), F.sum(through.cast("int")).alias("reads_through"))
