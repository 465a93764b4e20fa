"""Scripts, letter case, sound, transliteration and dictation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lingsmith.functions import casing, layouts, phonetic, scripts, speech, transliterate
from lingsmith.functions import text as X
from lingsmith.operators import lexicon as L
from lingsmith.plans._registry import WORDS, query, t

_R = scripts.RANGES
_EXACT, _MARKERS = ["of", "and", "thank you"], ["tion tion", "subtitles by"]
_SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def _norm(s: str) -> str:
    return rf"trim(regexp_replace(lower({s}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"


def _count(script: str, col: str = "text") -> str:
    return f"length(regexp_replace({col}, '[^{_R[script]}]', '', 'g'))"


def _first(c: str) -> str:
    return f"case when {c} = 'ß' then {c} else upper({c}) end"


def _opened(stops: str, before: str) -> str:
    part = f"regexp_extract(p, '^({before}*)', 1)"
    first = f"substr(p, length({part}) + 1, 1)"
    return f"coalesce(array_to_string(list_transform(regexp_extract_all(lower(text), '(?s)([^{stops}]+|[{stops}])'), lambda p: {part} || {_first(first)} || substr(p, length({part}) + 2)), ''), '')"


_SENTENCE = _opened(r".!?…\n։", r"[^\p{Lu}\p{Ll}\p{Lt}]")
_TITLE = _opened(r".!?…\n։\s", r"[^\p{L}\p{Nd}]")


def _docs(spark, d):
    return t(spark, d, "documents")


def _turns(spark, d):
    return t(spark, d, "conversations")


def _vocabulary(spark, d):
    return L.word_counts(_docs(spark, d)).select("word").distinct()


_VOCABULARY = f"(select distinct word from {WORDS})"


@query(f"select doc_id, {_SENTENCE} as text from documents")
def x02_sentence_case(spark, d):
    return _docs(spark, d).select("doc_id", casing.sentence_case(F.col("text")).alias("text"))


@query(rf"select conv_id, turn, case when not up and not low then text when up and not low then lower(text) when not up and sentence <> text then sentence when up and sentence = text and title <> text then title else replace(upper(replace(text, 'ß', chr(57344))), chr(57344), 'ß') end as text from (select *, regexp_matches(text, '\p{{Lu}}') as up, regexp_matches(text, '\p{{Ll}}') as low, {_SENTENCE} as sentence, {_TITLE} as title from conversations)")
def x01_next_case(spark, d):
    return _turns(spark, d).select("conv_id", "turn", casing.next_case(F.col("text")).alias("text"))


@query(f"select doc_id, {transliterate.sql('text', transliterate.CYRILLIC_IN)} as text from documents")
def x05_transliterated(spark, d):
    return _docs(spark, d).select("doc_id", transliterate.convert(F.lower("text")).alias("text"))


@query(f"select word, {transliterate.sql(transliterate.sql('word', transliterate.GREEK_IN), transliterate.GREEK_OUT)} as back from (select word from {_VOCABULARY} where regexp_matches(word, '^[a-z]+$'))")
def x06_greek_and_back(spark, d):
    there = transliterate.convert(F.col("word"), "Greek")
    return _vocabulary(spark, d).filter("word rlike '^[a-z]+$'").select("word", transliterate.rewritten(there, transliterate.GREEK_OUT).alias("back"))


@query(f"select word, {phonetic.sql('word')} as key from {_VOCABULARY}")
def x23_english_key(spark, d):
    return _vocabulary(spark, d).select("word", phonetic.english(F.col("word")).alias("key"))


@query(f"select word, {phonetic.sql_heard(transliterate.sql('word', transliterate.CYRILLIC_IN))} as key from (select word from {_VOCABULARY} where regexp_matches(word, '^[a-z]+$'))")
def x24_heard_key(spark, d):
    """Words as another script writes them."""
    words = _vocabulary(spark, d).filter("word rlike '^[a-z]+$'")
    return words.select("word", phonetic.heard(transliterate.rewritten(F.col("word"), transliterate.CYRILLIC_IN)).alias("key"))


@query(f"""with k as materialized (select lang, word, n, key, right(key, 1) as last, translate(key, 'aeiou', '') as bones from (select lang, word, n, {phonetic.sql('word')} as key from {WORDS})),
a as (select lang, word as heard, key as ka, last, bones from k where n < 20 and key <> ''), b as (select lang, word as term, n, key as kb, last, bones from k where n >= 20),
c as (select a.lang, heard, term, levenshtein(ka, kb)::int as dist, row_number() over (partition by a.lang, heard order by levenshtein(ka, kb), n desc, term) as r from a join b using (lang, last, bones)
where levenshtein(ka, kb) <= case when greatest(length(ka), length(kb)) <= 4 then 0 when greatest(length(ka), length(kb)) <= 7 then 1 else 2 end)
select lang, heard, term, dist from c where r = 1""")
def j09_term_lookup(spark, d):
    """The nearest frequent word of its language that sounds like each word of fewer than 20 occurrences."""
    # behind an aggregation, so that the long chain of rewrites is not copied into each use of the key
    k = L.word_counts(_docs(spark, d)).withColumn("key", phonetic.english(F.col("word"))).groupBy("lang", "word").agg(F.max("n").alias("n"), F.max("key").alias("key"))
    return L.sound_alikes(k.filter("n < 20").select("lang", F.col("word").alias("heard"), "key"), k.filter("n >= 20").select("lang", F.col("word").alias("term"), "n", "key"), ["lang"])


@query(f"select word, strip_accents(word) as bare from {_VOCABULARY}")
def x33_accent_blind(spark, d):
    return _vocabulary(spark, d).select("word", scripts.bare(F.col("word")).alias("bare"))


_V = scripts._vowels("Latin")


@query(f"""with w as (select word, {_count('Latin', 'word')} as n, length(regexp_replace(word, '[^{_V}]', '', 'g')) as v,
coalesce(list_max(list_transform(regexp_extract_all(regexp_replace(word, '[{_V}]', ' ', 'g'), '[{_R['Latin']}]+'), lambda x: length(x))), 0) as run from {_VOCABULARY}),
s as (select *, v / greatest(n, 1) as share from w)
select word, round(case when n = 0 then 0.0::double else (case when n >= 3 and v = 0 then 0.05::double else greatest(0.1::double, 1.0::double - 2.0::double * case when share < 0.2::double then 0.2::double - share when share > 0.6::double then share - 0.6::double else 0.0 end) end)
* case when run >= 5 then 0.2::double when run = 4 then 0.6::double else 1.0 end end, 9) as score from s""")
def x29_vowel_naturalness(spark, d):
    return _vocabulary(spark, d).select("word", F.round(scripts.naturalness(F.col("word")), 9).alias("score"))


@query(f"""select doc_id, array_to_string(list_filter(s, lambda x, i: i = 1 or {_norm('x')} <> {_norm('s[i - 1]')}), ' ') as text from (select doc_id, {_SENT} as s from documents)""")
def o11_sentence_loops(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(speech.without_loops(speech.sentences(F.col("text"))), " ").alias("text"))


@query(f"""with s as (select conv_id, turn, {_SENT} as s from conversations), l as (select *, {_norm('s[-1]')} as last from s)
select conv_id, turn, array_to_string(case when len(s) >= 2 and contains(last, ' ') and len(list_filter(s[:-2], lambda x: length({_norm('x')}) > length(last) and starts_with({_norm('x')}, last))) > 0 then s[:-2] else s end, ' ') as text from
(select conv_id, turn, case when turn % 2 = 0 then list_append(s, array_to_string(string_split(s[1], ' ')[:2], ' ')) else s end as s, {_norm('case when turn % 2 = 0 then array_to_string(string_split(s[1], chr(32))[:2], chr(32)) else s[-1] end')} as last from l)""")
def x18_cut_off_repeats(spark, d):
    """Every other turn ends on a copy of how its first sentence begins."""
    s = speech.sentences(F.col("text"))
    again = F.array_join(F.slice(F.split(F.get(s, 0), " "), 1, 2), " ")
    said = F.when(F.col("turn") % 2 == 0, F.array_append(s, again)).otherwise(s)
    x = _turns(spark, d).select("conv_id", "turn", said.alias("said"))
    return x.select("conv_id", "turn", F.array_join(speech.without_cut_off(F.col("said")), " ").alias("text"))


@query(f"""select doc_id, sum((n = '' or n in ({', '.join(map(repr, _EXACT))}) or {' or '.join(f"contains(n, '{m}')" for m in _MARKERS)})::int)::bigint as fillers, count(*) as n_sentences from (select doc_id, {_norm('x')} as n from (select doc_id, unnest({_SENT}) as x from documents)) group by 1""")
def x17_fillers(spark, d):
    x = _docs(spark, d).select("doc_id", F.explode(speech.sentences(F.col("text"))).alias("s"))
    return x.groupBy("doc_id").agg(F.sum(speech.is_filler(F.col("s"), _EXACT, _MARKERS).cast("int")).alias("fillers"), F.count("*").alias("n_sentences"))


@query(None)
def x20_cleaned(spark, d):
    """Repeated runs need back-references, which DuckDB lacks; tests compare with a plain loop."""
    return speech.cleaned(_docs(spark, d).select("doc_id", "text"), _EXACT, _MARKERS)


@query(r"select conv_id, turn, regexp_replace(regexp_replace(replace(replace(text, ' and ', ' full stop '), ' of ', ' comma '), '(?i)[ ,]*\bfull stop\b[.,]?', '.', 'g'), '(?i)[ ,]*\bcomma\b[.,]?', ',', 'g') as text from conversations")
def x21_spoken_marks(spark, d):
    said = F.replace(F.replace("text", F.lit(" and "), F.lit(" full stop ")), F.lit(" of "), F.lit(" comma "))
    return _turns(spark, d).select("conv_id", "turn", speech.spoken_marks(said, {"comma": ",", "full stop": "."}).alias("text"))


@query(r"""with p as (select conv_id, turn, text, coalesce(lag(case turn % 3 when 0 then text when 1 then text || ' and' else text || ' ' end) over (partition by conv_id order by turn), '') as b from conversations),
f as (select *, case when regexp_matches(regexp_replace(b, '\s+$', ''), '(^|[.!?…])$') then text when regexp_matches(text, '^\p{Lu}\p{Ll}+') then lower(substr(text, 1, 1)) || substr(text, 2) else text end as body from p)
select conv_id, turn, case when b = '' or regexp_matches(b, '\s$') or regexp_matches(text, '^[\s.,!?:;)…]') then body else ' ' || body end as text from f""")
def x14_fit_after(spark, d):
    ended = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" and"))).otherwise(F.concat("text", F.lit(" ")))
    before = F.coalesce(F.lag(ended).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return _turns(spark, d).withColumn("b", before).select("conv_id", "turn", speech.fit_after(F.col("text"), F.col("b")).alias("text"))


_TYPED = r"case when pos % 7 >= 3 and length(w) >= 2 then lower(substr(w, 1, 1)) || replace(upper(replace(substr(w, 2), 'ß', chr(57344))), chr(57344), 'ß') else w end"


@query(rf"""with w as (select conv_id, turn, pos, {_TYPED} as w from (select conv_id, turn, generate_subscripts(x, 1) - 1 as pos, unnest(x) as w from (select conv_id, turn, regexp_extract_all(text, '\p{{L}}+') as x from conversations))),
m as (select *, max(regexp_matches(w, '^\p{{Ll}}\p{{Lu}}{{4,}}$')::int) over (partition by conv_id, turn order by pos) as on_ from w)
select conv_id, turn, pos, case when on_ = 1 and regexp_matches(w, '^\p{{Lu}}{{2,}}$') then lower(w) when on_ = 1 and regexp_matches(w, '^\p{{Ll}}\p{{Lu}}+$') then {_first('substr(w, 1, 1)')} || lower(substr(w, 2)) else w end as word from m""")
def x12_caps_lock_undone(spark, d):
    """From the first word of five letters or more typed under Caps Lock, such words change their case."""
    w = _turns(spark, d).select("conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("pos", "w")).withColumn("pos", F.col("pos").cast("long"))
    typed = w.withColumn("w", F.when((F.col("pos") % 7 >= 3) & (F.length("w") >= 2), F.concat(F.lower(F.substring("w", 1, 1)), casing.upper(F.expr("substring(w, 2)")))).otherwise(F.col("w")))
    return X.caps_lock_undone(typed, ["conv_id", "turn"])


_MIX = "(select doc_id, case when doc_id % 2 = 0 then text else substr(text, 1, 60) || translate(substr(text, 61), $a${}$a$, $b${}$b$) end as text from documents)".format(*layouts.pairs("ru"))


def _half(spark, d):
    x = F.col("text")
    moved = F.concat(F.substring(x, 1, 60), layouts.transcode(F.substr(x, F.lit(61)), "ru"))
    return _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, x).otherwise(moved).alias("text"))


@query("select doc_id, (list_max([" + ", ".join(f"{{'n': {_count(s)}, 'at': -length(regexp_extract(text, '(?s)^([^{r}]*)', 1)), 's': '{s}'}}" for s, r in _R.items()) + f"])).s as script from {_MIX} where " + " or ".join(f"{_count(s)} > 0" for s in _R))
def s03_majority_script(spark, d):
    return _half(spark, d).select("doc_id", scripts.majority(F.col("text")).alias("script")).filter("script is not null")


@query("select script, count(*) as n from (select case " + " ".join(f"when regexp_matches(c, '[{r}]') then '{s}'" for s, r in _R.items()) + rf" end as script from (select unnest(regexp_extract_all(text, '\p{{L}}')) as c from {_MIX})) group by 1")
def s01_letters_by_script(spark, d):
    """Letters of all texts by script (null: of none)."""
    c = F.col("c")
    of = F.lit(None).cast("string")
    for s in reversed(_R):
        of = F.when(c.rlike(f"[{_R[s]}]"), F.lit(s)).otherwise(of)
    x = _half(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L})"), 1)).alias("c"))
    return x.groupBy(of.alias("script")).agg(F.count("*").alias("n"))


@query(rf"select doc_id, count(*) as n, sum(regexp_matches(w, '^[{_R['Latin']}]+$')::int)::bigint as latin, sum(regexp_matches(w, '^[{_R['Cyrillic']}]+$')::int)::bigint as cyrillic, sum((regexp_matches(w, '[{_R['Latin']}]') and regexp_matches(w, '[{_R['Cyrillic']}]'))::int)::bigint as mixed from (select doc_id, unnest(regexp_extract_all(text, '\p{{L}}+')) as w from {_MIX}) group by 1")
def f01_words_of_script(spark, d):
    """Words of one script and of two (F01, F03)."""
    w = _half(spark, d).select("doc_id", F.explode(X.words(F.col("text"))).alias("w"))
    x = F.col("w")
    mixed = x.rlike(f"[{_R['Latin']}]") & x.rlike(f"[{_R['Cyrillic']}]")
    total = lambda c: F.sum(c.cast("int"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), total(scripts.is_word_of(x, "Latin")).alias("latin"), total(scripts.is_word_of(x, "Cyrillic")).alias("cyrillic"), total(mixed).alias("mixed"))


@query(rf"select word from {_VOCABULARY} where regexp_matches(word, '\p{{L}}') and regexp_replace(word, '[abcdefghijklmnopqrstuvwxyzäöüß]', '', 'g') = ''")
def f02_words_of_alphabet(spark, d):
    return _vocabulary(spark, d).filter(scripts.within(F.col("word"), "abcdefghijklmnopqrstuvwxyzäöüß"))


_CYR = "translate(word, $a${}$a$, $b${}$b$)".format(*layouts.pairs("ru"))


@query(f"select word, not (regexp_matches({_CYR}, '(^|[^{_R['Cyrillic']}])[ыь][{_R['Cyrillic']}]') or regexp_matches({_CYR}, '[ьъы][ьъы]')) as possible from {_VOCABULARY}")
def f07_possible_spelling(spark, d):
    typed = layouts.transcode(F.col("word"), "ru")
    return _vocabulary(spark, d).select("word", scripts.possible(typed, "Cyrillic").alias("possible"))


@query(f"select doc_id, regexp_replace(text, '(?s)^[^{_R['Latin']}]+|[^{_R['Latin']}]+$', '', 'g') as text from documents")
def s12_trimmed(spark, d):
    return _docs(spark, d).select("doc_id", scripts.trimmed(F.col("text"), "Latin").alias("text"))


@query("select p_partkey, case when p_partkey % 2 = 0 then upper(substr(p_name, 1, 1)) || substr(p_name, 2) else p_name end as name from part")
def s10_case_restored(spark, d):
    original = F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", scripts.like_case(F.col("p_name"), original).alias("name"))


@query("select doc_id, lower(split_part(replace(tag, '_', '-'), '-', 1)) as code from (select doc_id, lang || case doc_id % 3 when 0 then '-DE' when 1 then '_BR' else '' end as tag from documents)")
def s17_language_code(spark, d):
    tag = F.concat("lang", F.when(F.col("doc_id") % 3 == 0, "-DE").when(F.col("doc_id") % 3 == 1, "_BR").otherwise(""))
    return _docs(spark, d).select("doc_id", X.language_code(tag).alias("code"))


@query(r"select conv_id, turn, regexp_extract(text, '(\S*)$', 1) as chunk from conversations")
def t15_current_chunk(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.regexp_extract("text", r"(\S*)\z", 1).alias("chunk"))


@query(r"select doc_id, regexp_replace(text, '([^ \t\n]+)', '<\1>', 'g') as text from documents")
def t02_chunks_replaced(spark, d):
    """Chunks change, what stands between them does not."""
    return _docs(spark, d).select("doc_id", F.regexp_replace("text", r"([^ \t\n]+)", "<$1>").alias("text"))
