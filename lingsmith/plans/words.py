"""Words under their marks, their lists, and which of them stay: folding, neighbours, exceptions, glossaries, corpora."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lingsmith.functions import keyboards as B
from lingsmith.functions import phonetic, scripts
from lingsmith.functions import text as X
from lingsmith.operators import lexicon as L
from lingsmith.operators import lookup as K
from lingsmith.plans._registry import WORDS, query, t
from lingsmith.plans.keyboards import _PARTS, _read, _text

_R = scripts.RANGES
_VOCABULARY = f"(select distinct word from {WORDS})"


def _docs(spark, d):
    return t(spark, d, "documents")


def _counts(spark, d):
    return L.word_counts(_docs(spark, d))


def _vocabulary(spark, d):
    return _counts(spark, d).select("word").distinct()


def _n(c: str, of: str) -> str:
    return f"length(regexp_replace({c}, '[^{of}]', '', 'g'))"


_MIXED_WORD = "case when length(word) % 3 = 0 then translate(word, 'aeopc', 'аеорс') else word end"


def _mixed_word():
    """Words as written with look-alike letters of another script, some of them throughout."""
    return F.when(F.length("word") % 3 == 0, F.translate("word", "aeopc", "аеорс")).otherwise(F.col("word"))


@query(f"select word, w as written from (select word, {_MIXED_WORD} as w from {_VOCABULARY}) where regexp_matches(w, '[{_R['Latin']}]') and regexp_matches(w, '[{_R['Cyrillic']}]')")
def f03_two_alphabets(spark, d):
    """Words with letters of two scripts: misspellings that a list must not hold."""
    return _vocabulary(spark, d).select("word", _mixed_word().alias("written")).filter(scripts.mixed(F.col("written")))


@query(f"select script, case when script in ('Latin', 'Hebrew', 'Arabic') then 0 else sum((regexp_matches(w, '[{_R['Latin']}]') and regexp_matches(w, '[{_R['Cyrillic']}]'))::int) end::bigint as removed from (select {_MIXED_WORD} as w from {_VOCABULARY}), (select unnest(['Latin', 'Cyrillic', 'Hebrew', 'Arabic']) as script) group by 1")
def f04_cleaned_scripts(spark, d):
    """How many words cleaning removes from a list of each script: none from abjads and Latin lists."""
    bad = _vocabulary(spark, d).select(scripts.mixed(_mixed_word()).cast("int").alias("bad")).agg(F.sum("bad").alias("bad"))
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("script"), F.lit(s in ("Latin", *scripts.ABJAD)).alias("skipped")) for s in ("Latin", "Cyrillic", "Hebrew", "Arabic")]))
    return bad.select("bad", rows.alias("r")).select("r.script", F.when(F.col("r.skipped"), 0).otherwise(F.col("bad")).alias("removed"))


_CASED = r"(select lang, w as word, count(*) as n from (select lang, unnest(regexp_extract_all(text, '\p{L}+')) as w from documents) group by all)"
_OWN = f"(select distinct word from {WORDS} where lang = 'fr' and n > 2)"
_NEAR = f"(select distinct word from {WORDS} where lang = 'es')"
_CAPITAL = "upper(substr(word, 1, 1)) || lower(substr(word, 2))"
_NEIGHBOUR = f"(select word, n, (word not in {_OWN} and lower(word) not in {_OWN} and lower(word) in {_NEAR}) as neighbour from {_CASED} where lang = 'fr')"


def _cased(spark, d):
    return _docs(spark, d).select("lang", F.explode(X.words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def _neighbours(spark, d):
    c = _counts(spark, d)
    own = c.filter("lang = 'fr' and n > 2").select("word")
    near = c.filter("lang = 'es'").select("word")
    return L.neighbour_words(_cased(spark, d).filter("lang = 'fr'").select("word", "n"), own, near)


@query(f"select word, neighbour from {_NEIGHBOUR}")
def f05_neighbour_words(spark, d):
    """French words of the documents that only the Spanish list accepts."""
    return _neighbours(spark, d).select("word", "neighbour")


@query(f"select count(*) filter (where not neighbour) as kept, count(*) filter (where neighbour) as removed, coalesce(sum(n) filter (where neighbour), 0)::bigint as removed_n from {_NEIGHBOUR}")
def f06_neighbours_removed(spark, d):
    x = F.col("neighbour")
    return _neighbours(spark, d).agg(F.count_if(~x).alias("kept"), F.count_if(x).alias("removed"), F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias("removed_n"))


_GLOSSARY = ["Pull Request|heard so", "Kubernetes", "de la mer|x|y", "the", "Wort-Art| "]
_GLOSSED = f"(select distinct lower(regexp_replace(w, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g')) as word from (select unnest(regexp_extract_all(string_split(l, '|')[1], '\\S+')) as w from (select unnest([{', '.join(map(_text, _GLOSSARY))}]) as l)) where regexp_matches(w, '\\p{{L}}'))"


def _glossary(spark):
    return L.glossary_words(spark.createDataFrame([(x,) for x in _GLOSSARY], "value string"))


@query(f"select word from {_GLOSSED}")
def f13_glossary_words(spark, d):
    return _glossary(spark)


_USER = "(select unnest(['and', 'und', 'est', 'request']) as word)"


def _listed(spark):
    return spark.createDataFrame([("and",), ("und",), ("est",), ("request",)], "word string").union(_glossary(spark)).distinct()


@query(f"select word from {_USER} union select word from {_GLOSSED}")
def u02_leave_alone_list(spark, d):
    """The user's own words and those of the glossary."""
    return _listed(spark)


_KEY = r"lower(regexp_replace(w, '^[^\p{L}]+|[^\p{L}]+$', '', 'g'))"
_CHUNKS = f"(select doc_id, generate_subscripts(p, 1) - 1 as pos, unnest(p) as w from (select doc_id, regexp_extract_all(text, {_PARTS}) as p from documents))"
_LISTED = f"(select word from {_USER} union select word from {_GLOSSED})"


def _chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?U)(\S+|\s+)"), 1)).alias("pos", "w"))


@query(f"select doc_id, count(*) as chunks, sum(({_KEY} in {_LISTED})::int)::bigint as left_alone from {_CHUNKS} where regexp_matches(w, '\\p{{L}}') group by 1")
def f12_left_alone(spark, d):
    """Chunks of each text that are on the leave-alone list, under their letters in small."""
    c = _chunks(spark, d).filter(F.col("w").rlike(r"\p{L}")).withColumn("word", X.letters_key(F.col("w")))
    hit = c.join(F.broadcast(_listed(spark).withColumn("hit", F.lit(1))), "word", "left")  # a user's own list
    return hit.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.coalesce("hit", F.lit(0))).alias("left_alone"))


@query(f"select doc_id, start, n from (select doc_id, w, length(w) as n, coalesce(sum(length(w)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start from {_CHUNKS}) where {_KEY} in {_LISTED}")
def t14_exception_spans(spark, d):
    """Where the chunks on the leave-alone list stand; only texts that hold one are laid out chunk by chunk."""
    listed = F.broadcast(_listed(spark))
    c = _chunks(spark, d)
    with_one = c.select("doc_id", X.letters_key(F.col("w")).alias("word")).join(listed, "word", "left_semi").select("doc_id").distinct()
    at = F.coalesce(F.sum(F.length("w")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = c.join(with_one, "doc_id", "left_semi").withColumn("start", at).withColumn("word", X.letters_key(F.col("w")))
    return placed.join(listed, "word", "left_semi").select("doc_id", F.col("start").cast("long").alias("start"), F.length("w").cast("long").alias("n"))


@query(f"select doc_id, {_n('lower(text)', _R['Latin'])}::bigint as letters, {_n('lower(text)', scripts._vowels('Latin'))}::bigint as vowels, {_n('lower(c)', _R['Cyrillic'])}::bigint as cyrillic, {_n('lower(c)', scripts._vowels('Cyrillic'))}::bigint as cyrillic_vowels from (select doc_id, text, {_read('text', B.rules(('en',), 'uk'))} as c from documents)")
def s05_letters_and_vowels(spark, d):
    """Letters and vowels of a text, and of the same keys on a Cyrillic layout."""
    c = B.transcode(F.col("text"), "en", "uk")
    count = lambda x, of: F.length(F.regexp_replace(F.lower(x), f"[^{of}]++", "")).cast("long")
    x = F.col("text")
    return _docs(spark, d).select("doc_id", count(x, _R["Latin"]).alias("letters"), count(x, scripts._vowels("Latin")).alias("vowels"), count(c, _R["Cyrillic"]).alias("cyrillic"), count(c, scripts._vowels("Cyrillic")).alias("cyrillic_vowels"))


@query("select distinct c as letter from (select lower(chr(i::int)) as c from (select unnest(range(192, 592)) as i union all select unnest(range(7680, 7936))) union all select unnest(regexp_extract_all('aeiouyıøæœơư', '.'))) where regexp_matches(c, '\\p{L}') and length(c) = 1 and (c in ('a', 'e', 'i', 'o', 'u', 'y', 'ı', 'ø', 'æ', 'œ', 'ơ', 'ư') or strip_accents(c) in ('a', 'e', 'i', 'o', 'u', 'y', 'ı', 'ø', 'æ', 'œ', 'ơ', 'ư'))")
def s06_latin_vowels(spark, d):
    """Latin vowels with all the letters that decompose to one."""
    return spark.createDataFrame([(c,) for c in sorted(set(scripts.latin_vowels()))], "letter string")


_FOLDS = {"uk": "replace(replace({}, '’', ''''), 'ʼ', '''')", "he": "regexp_replace(replace(replace({}, '׳', ''''), '״', '\"'), '[\\x{{0591}}-\\x{{05AF}}\\x{{05B0}}-\\x{{05C7}}]', '', 'g')", "hy": "regexp_replace({}, '[՛՜՞]', '', 'g')"}


def _typed_sql(to: str) -> str:
    return _read("replace(word, 'ss', '’s')", B.rules(("en",), to))


def _typed_word(to: str):
    return B.transcode(F.replace("word", F.lit("ss"), F.lit("’s")), "en", to)


@query("select word, " + ", ".join(f"{f.format(_typed_sql(k))} as {k}" for k, f in _FOLDS.items()) + f" from {_VOCABULARY}")
def s07_folded_marks(spark, d):
    """Words as other layouts read their keys, with marks left out or unified."""
    name = {"uk": "Cyrillic", "he": "Hebrew", "hy": "Armenian"}
    return _vocabulary(spark, d).select("word", *[scripts.marks_folded(_typed_word(k), s).alias(k) for k, s in name.items()])


@query(f"select word, regexp_replace(lower({_typed_sql('uk')}), '[''’ʼ]', '', 'g') as uk, regexp_replace(translate(lower({_typed_sql('ar')}), 'أإآ', 'ااا'), '(.)ة$', '\\1ه') as ar, replace(regexp_replace(lower({_typed_sql('hy')}), '[՛՜՞]', '', 'g'), 'և', 'եւ') as hy from {_VOCABULARY}")
def s08_lookup_keys(spark, d):
    """The forms under which words are looked up, by script."""
    name = {"uk": "Cyrillic", "ar": "Arabic", "hy": "Armenian"}
    return _vocabulary(spark, d).select("word", *[scripts.folded(_typed_word(k), s).alias(k) for k, s in name.items()])


@query(f"select lang, word, case when lang = 'fr' then translate(replace(word, 's', 'ş'), 'şţ', 'șț') else replace(word, 's', 'ş') end as folded from {WORDS}")
def s09_cedillas(spark, d):
    """Letters with a cedilla become those with a comma in one language's list only."""
    w = F.replace("word", F.lit("s"), F.lit("ş"))
    return _counts(spark, d).select("lang", "word", scripts.cedilla_folded(w, F.col("lang") == "fr").alias("folded"))


_CLASSES = "(select * from (values ('Latin', false, false, false), ('Cyrillic', false, false, false), ('Greek', false, false, false), ('Hebrew', true, false, true), ('Arabic', true, false, true), ('Georgian', false, true, true), ('Armenian', false, true, false), ('Hangul', false, true, true)) v(script, abjad, phonetic, caseless))"


@query(f"select a.script as script, b.script as other, a.abjad or a.phonetic as blind, a.caseless as caseless, a.abjad or b.abjad or (a.script = 'Latin' and b.phonetic) or (b.script = 'Latin' and a.phonetic) as blind_pair from {_CLASSES} a, {_CLASSES} b where a.script <> b.script")
def s11_script_classes(spark, d):
    """Scripts that a score can't judge, alone or in pairs, and those without capitals: 56 rows."""
    rows = [(a, b, scripts.is_blind(a), a in scripts.CASELESS, scripts.is_blind_pair(a, b)) for a in _R for b in _R if a != b]
    return spark.createDataFrame(rows, "script string, other string, blind boolean, caseless boolean, blind_pair boolean")


@query(r"select doc_id, len(list_filter(regexp_extract_all(text, '(?s).'), lambda c, i: regexp_matches(c, '\p{L}') and not ((i - 1 >= 3 and i - 1 < length(text) // 2) or (i - 1 >= length(text) // 3 and i - 1 < length(text) - doc_id % 3)))) = 0 and regexp_matches(text, '\p{L}') as covered from documents")
def s15_letters_covered(spark, d):
    """Whether two spans that overlap hold every letter of a text."""
    n = F.length("text")
    spans = F.array(F.struct(F.lit(3).alias("start"), F.floor(n / 2).cast("int").alias("end")), F.struct(F.floor(n / 3).cast("int").alias("start"), (n - F.col("doc_id") % 3).cast("int").alias("end")))
    return _docs(spark, d).select("doc_id", X.covers_letters(F.col("text"), spans).alias("covered"))


@query(r"select doc_id, len(regexp_extract_all(text, '(?:^|[^\p{L}\p{Nd}''’])[\p{L}\p{Nd}]'))::bigint as begun, len(regexp_extract_all(text || ' ', '[\p{L}\p{Nd}](?:[^\p{L}\p{Nd}''’])'))::bigint as ended from documents")
def x08_word_edges(spark, d):
    """Places where words begin and end: apostrophes belong to them."""
    begun = F.regexp_count("text", F.lit(r"(?<![\p{L}\p{Nd}'’])[\p{L}\p{Nd}]"))
    ended = F.regexp_count("text", F.lit(r"[\p{L}\p{Nd}](?![\p{L}\p{Nd}'’])"))
    return _docs(spark, d).select("doc_id", begun.cast("long").alias("begun"), ended.cast("long").alias("ended"))


@query(r"select lower(w) as word, count(*) as n from (select unnest(regexp_extract_all(text, '[\p{L}\p{M}](?:[\p{L}\p{M}\p{Nd}]|[''’]\p{L})*')) as w from conversations) group by 1")
def t12_term_words(spark, d):
    """Words in which a term may stand: marks, digits and inner apostrophes included."""
    return t(spark, d, "conversations").select(F.explode(X.term_words(F.col("text"))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


@query(f"select word, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, 'a+', 'a', 'g'), 'e+', 'e', 'g'), 'l+', 'l', 'g'), 's+', 's', 'g'), 'o+', 'o', 'g'), 't+', 't', 'g') as key from (select distinct w as word from (select regexp_replace(word, '[^aelost]', '', 'g') as w from {_VOCABULARY}) where w <> '')")
def x25_doubles_collapsed(spark, d):
    """Runs of one letter as one, of words cut down to six letters."""
    w = F.regexp_replace("word", "[^aelost]", "")
    return _vocabulary(spark, d).select(w.alias("word")).filter("word <> ''").distinct().select("word", phonetic.doubles_collapsed(F.col("word")).alias("key"))


@query(f"select a.word as word, b.word as other, levenshtein(a.word, b.word)::int as dist from {_VOCABULARY} a join {_VOCABULARY} b on b.word = a.word || 's' or b.word = a.word || 'es'")
def x32_levenshtein(spark, d):
    """Words beside those with an ending more."""
    v = _vocabulary(spark, d)
    long = v.select("word", F.explode(F.array(F.concat("word", F.lit("s")), F.concat("word", F.lit("es")))).alias("other"))
    return long.join(v.withColumnRenamed("word", "other"), "other", "left_semi").select("word", "other", F.levenshtein("word", "other").alias("dist"))


_CLOSE = "case when greatest(length(a.word), length(b.word)) <= 4 then 0 when greatest(length(a.word), length(b.word)) <= 7 then 1 else 2 end"


@query(f"with k as (select word, translate(word, 'aeiou', '') as bones, right(word, 1) as last from {WORDS} where lang = 'en') select a.word as word, b.word as other from k a join k b using (bones, last) where a.word < b.word and levenshtein(a.word, b.word) <= {_CLOSE}")
def x27_close_sounds(spark, d):
    """English words that sound alike: the same consonants and last letter, vowels a little apart."""
    k = _counts(spark, d).filter("lang = 'en'").select("word", phonetic.skeleton(F.col("word")).alias("bones"), F.right("word", F.lit(1)).alias("last"))
    both = k.join(k.withColumnRenamed("word", "other"), ["bones", "last"]).filter("word < other")
    return both.filter(phonetic.close(F.col("word"), F.col("other"))).select("word", "other")


@query(f"select word, o.n as n, coalesce(r.n, 0)::bigint as other, round(o.n / (coalesce(r.n, 0) + 1.0), 6) as ratio from {WORDS} o left join (select word, n from {WORDS} where lang = 'de') r using (word) where o.lang = 'en'")
def j13_corpus_ratios(spark, d):
    """Counts in one corpus over those in another, where unseen words count as one."""
    c = _counts(spark, d)
    both = K.known(c.filter("lang = 'en'").select("word", F.col("n").alias("own")), c.filter("lang = 'de'")).withColumnRenamed("n", "other")
    return both.select("word", F.col("own").alias("n"), "other", F.round(F.col("own") / (F.col("other") + 1.0), 6).alias("ratio"))


@query("select coalesce(a.event_type, b.event_type) as metric, a.n as before, b.n as now, case when b.n is null then 'gone' when a.n is null then 'new' when a.n <> b.n then 'moved' else 'same' end as state from (select event_type || user_id % 40 as event_type, count(*) as n from events where event_id % 2 = 0 group by 1) a full join (select event_type || user_id % 40 as event_type, count(*) as n from events where event_id % 3 = 0 group by 1) b using (event_type)")
def j15_baseline_join(spark, d):
    """Metrics of a baseline beside current ones: gone, new, moved."""
    e = t(spark, d, "events").withColumn("metric", F.concat("event_type", (F.col("user_id") % 40).cast("string")))
    side = lambda k, n: e.filter(F.col("event_id") % k == 0).groupBy("metric").agg(F.count("*").alias(n))
    both = side(2, "before").join(side(3, "now"), "metric", "full_outer")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("before").isNull(), "new").when(F.col("before") != F.col("now"), "moved").otherwise("same")
    return both.select("metric", "before", "now", state.alias("state"))


_ALL = f"""with k as {WORDS}, c as (select *, ln(1+n) as w, unnest(range(1, length(word) + 2)) as i from k),
g as (select lang, w, substr('^^' || word || '$', i, 3) as tri, substr('^^' || word || '$', i, 2) as ctx from c),
tt as (select tri, sum(w) as t from g where lang = 'de' group by all), cc as (select ctx, sum(w) as c from g where lang = 'de' group by all),
a as (select count(distinct ch) + 1 as size from (select unnest(string_split(word, '')) as ch from k where lang = 'de')),
h as (select word, substr('^^' || word || '$', i, 3) as tri, substr('^^' || word || '$', i, 2) as ctx from (select word, unnest(range(1, length(word) + 2)) as i from k where lang = 'en'))
select word, round(avg(log10((coalesce(t, 0) + 0.5) / (coalesce(c, 0) + 0.5 * size))), 5) as fit from h left join tt using (tri) left join cc using (ctx), a group by word"""


@query(_ALL)
def a09_language_fit(spark, d):
    """How well English words fit the German model of letters."""
    c = _counts(spark, d)
    return L.fits(c.filter("lang = 'en'").select("word"), c.filter("lang = 'de'"))
