"""Lines typed on the wrong layout put right, with the steps on the way and the rates that tell how well it goes.

Word lists come from the documents: English words as they are, Spanish ones as the Ukrainian layout reads their keys. A
Spanish document is then a text whose writer forgot to switch, and what it was meant to be is known.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lingsmith.functions import keyboards as B
from lingsmith.functions import scripts
from lingsmith.operators import brain
from lingsmith.operators import lexicon as L
from lingsmith.plans._registry import WORDS, query, t
from lingsmith.plans.keyboards import _dominant, _read, _text

KEYS = brain.Keyboards("en", ("uk",))
SCRIPTS = {"en": "Latin", "uk": "Cyrillic"}


def _docs(spark, d):
    return t(spark, d, "documents")


def _lists(spark, d):
    """(lang, word, n, freq): English words, and Spanish ones of plain letters on the Ukrainian layout."""
    c = L.word_counts(_docs(spark, d))
    uk = c.filter("lang = 'es' and word rlike '^[a-z]+$'").select(F.lit("uk").alias("lang"), B.transcode(F.col("word"), "en", "uk").alias("word"), "n")
    return brain.kept(L.log_frequency(c.filter("lang = 'en'").unionByName(uk)))


def _lines(spark, d, langs=("en", "es")):
    return _docs(spark, d).filter(F.col("lang").isin(*langs)).select(F.col("doc_id").alias("line_id"), "lang", "text")


_FREQ = f"(select lang, word, round(least(1.0, ln(1+n) / ln(1+max(n) over (partition by lang))), 6) as freq from (select 'uk' as lang, {_read('word', B.rules(('en',), 'uk'))} as word, n from {WORDS} where lang = 'es' and regexp_matches(word, '^[a-z]+$') union all select 'en', word, n from {WORDS} where lang = 'en'))"
_SEEN = f"(select distinct word from {WORDS} where lang in ('en', 'es'))"


@query(f"select word, case when e.freq is not null then 'hit' else 'none' end as typed, case when u.freq is not null then 'hit' else 'none' end as read from {_SEEN} w left join (select word, freq from {_FREQ} where lang = 'en') e using (word) left join (select word as other, freq from {_FREQ} where lang = 'uk') u on u.other = regexp_replace({_read('w.word', B.rules(('en',), 'uk'))}, '^[^\\x{{0400}}-\\x{{04FF}}]+|[^\\x{{0400}}-\\x{{04FF}}]+$', '', 'g')")
def b02_hit_classes(spark, d):
    """Whether each word is a listed one as typed and as the other layout reads it."""
    lists = _lists(spark, d)
    words = L.word_counts(_docs(spark, d)).filter("lang in ('en', 'es')").select("word").distinct()
    read = words.select("word", B.transcode(F.col("word"), "en", "uk").alias("other"))
    asked = read.select(F.lit("en").alias("lang"), F.col("word").alias("text")).union(read.select(F.lit("uk"), "other"))
    s = brain.scored(asked, lists, SCRIPTS)
    kind = F.when(brain.is_hit(F.col("score")), "hit").otherwise("none")
    side = lambda lang, name, key: s.filter(F.col("lang") == lang).select(F.col("text").alias(key), kind.alias(name))
    return read.join(side("en", "typed", "word"), "word").join(side("uk", "read", "other"), "other").select("word", "typed", "read")


@query(None)
def b03_scoring_naturalness(spark, d):
    """How natural each Spanish word looks as English, 0 to 1, for words that no list holds."""
    c = L.word_counts(_docs(spark, d))
    asked = c.filter("lang = 'es'").select(F.lit("en").alias("lang"), F.col("word").alias("text"))
    return brain.scored(asked, _lists(spark, d), SCRIPTS).select("text", F.round("natural", 4).alias("natural"))


@query(rf"select lang, w as word, length(w) >= 2 and regexp_matches(w, '^[{scripts.RANGES['Latin']}]+$') and not regexp_matches(substr(w, 2), '\p{{Lu}}') as may from (select distinct lang, unnest(regexp_extract_all(text, '\p{{L}}+')) as w from documents)")
def b04_respelling_gate(spark, d):
    """Words that may be looked up for slips."""
    w = _docs(spark, d).select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("word")).distinct()
    return w.select("lang", "word", brain.may_be_respelled(F.col("word"), "Latin").alias("may"))


def _vocabulary(spark, d):
    return brain.kept(L.word_counts(_docs(spark, d)).filter("lang in ('en', 'es')").select(F.col("word").alias("typed")).distinct())


@query(None)
def b05_best_words(spark, d):
    """The best reading of each word by itself (B06 to B08 inside)."""
    return brain.best_words(_vocabulary(spark, d), KEYS, _lists(spark, d), SCRIPTS).select("typed", "text", "layout", "edits", F.round("score", 4).alias("score"), "changed")


@query(None)
def b09_best_splits(spark, d):
    """Words that are two listed words typed on two layouts: joined of the commonest of both lists."""
    lists = _lists(spark, d)
    top = lambda lang: lists.filter(F.col("lang") == lang).filter("length(word) between 4 and 7").orderBy(F.desc("n"), "word").limit(20)
    en, uk = top("en").select(F.col("word").alias("a")), top("uk").select(B.transcode(F.col("word"), "uk", "en").alias("b"))
    glued = en.withColumn("k", F.lit(1)).join(uk.withColumn("k", F.lit(1)), "k").select(F.concat("a", "b").alias("typed"))  # 20 by 20 words
    return brain.split_words(brain.best_words(glued, KEYS, lists, SCRIPTS), KEYS, lists, SCRIPTS).select("typed", "text")


@query(None)
def b11_read_elsewhere(spark, d):
    """Each word as one word of the other script, where it is listed there or looks like one."""
    return brain.read_elsewhere(_vocabulary(spark, d), KEYS, _lists(spark, d), SCRIPTS).select("typed", "script", "text", "layout")


@query(None)
def b14_corrected_lines(spark, d):
    """Whole texts put right: words read, lines revised (B12), written out with their signs (B13)."""
    return brain.corrected(_lines(spark, d).drop("lang"), KEYS, _lists(spark, d), SCRIPTS)


@query(None)
def e06_wrong_layout_lines(spark, d):
    """Rates over whole lines: words of Spanish texts read as meant, English words left as they are."""
    lines = brain.kept(_lines(spark, d))
    out = brain.corrected(lines.drop("lang"), KEYS, _lists(spark, d), SCRIPTS)
    meant = F.when(F.col("lang") == "es", B.transcode(F.col("text"), "en", "uk")).otherwise(F.col("text"))
    words = lambda x: F.regexp_extract_all(x, F.lit(r"(\p{L}+)"), 1)
    from lingsmith.operators import evidence

    x = out.join(L.shuffled(lines), "line_id").withColumn("a", words(F.col("corrected"))).withColumn("b", words(meant))
    return x.groupBy("lang").agg(F.count("*").alias("lines"), F.sum(F.size("b")).alias("words"), F.sum(evidence.same_places(F.col("a"), F.col("b"))).alias("right"), F.sum(F.when(F.col("target") == "uk", 1).otherwise(0)).alias("switched"))


@query(None)
def e07_target_layouts(spark, d):
    """How many lines ask for the right layout, with and without revising them: Spanish texts whose writer forgot to switch
    ask for the Ukrainian one, a Spanish word before an English text does not. The word is one of the 64 commonest."""
    heads = L.word_counts(_docs(spark, d)).filter("lang = 'es' and word rlike '^[a-z]{4,}$'").orderBy(F.desc("n"), "word").limit(64)
    heads = heads.agg(F.array_sort(F.collect_list("word")).alias("heads"))
    lines = _lines(spark, d).join(F.broadcast(heads))
    head = F.get("heads", F.pmod(F.xxhash64("line_id"), F.size("heads")).cast("int"))
    lines = brain.kept(lines.select(F.concat_ws(":", "lang", "line_id").alias("line_id"), F.when(F.col("lang") == "es", F.col("text")).otherwise(F.concat_ws(" ", head, "text")).alias("text")))
    lists = _lists(spark, d)
    asked = lambda context: brain.corrected(lines, KEYS, lists, SCRIPTS, context=context).select("line_id", F.coalesce(F.col("target") == "uk", F.lit(False)).alias("uk"))
    both = asked(False).withColumnRenamed("uk", "before").join(L.shuffled(asked(True)), "line_id").withColumn("es", F.col("line_id").startswith("es:"))
    right = lambda c: F.sum(F.when(F.col(c) == F.col("es"), 1).otherwise(0))
    kind = F.when(F.col("es"), "wrong layout").otherwise("finished in English").alias("line")
    return both.groupBy(kind).agg(F.count("*").alias("lines"), right("before").alias("right_alone"), right("uk").alias("right_revised"))


_CARRY = re.escape(brain.letter_keys(KEYS))
_INNER = re.escape("".join(sorted(set(brain.letter_keys(KEYS) + brain.inner_marks(KEYS)))))


@query(rf"select doc_id, count(*) as words, sum(length(w))::bigint as chars from (select doc_id, unnest(regexp_extract_all(text, {_text(rf'\p{{L}}(?:[{_INNER}]*\p{{L}})*')})) as w from documents) group by 1")
def t04_layout_words(spark, d):
    """Words whose inner signs are keys of letters, or marks, on another layout."""
    w = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"(\p{{L}}(?:[{_INNER}]*\p{{L}})*)"), 1)).alias("w"))
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum(F.length("w")).alias("chars"))


@query(rf"select doc_id, w as run, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, {_text(rf'\p{{L}}([{_CARRY}]+)')}, 1)) as w from documents) group by all")
def t05_trailing_runs(spark, d):
    """Keys of letters that follow a word."""
    w = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"\p{{L}}([{_CARRY}]+)"), 1)).alias("run"))
    return w.groupBy("doc_id", "run").agg(F.count("*").alias("n"))


@query("select source, kind, keys from (values " + ", ".join(f"('{k.source}', '{name}', {_text(f(k))})" for k in (KEYS, brain.Keyboards("en", ("el", "he")), brain.Keyboards("uk", ("en",))) for name, f in (("letters", brain.letter_keys), ("marks", brain.inner_marks), ("accents", brain.accent_keys))) + ") v(source, kind, keys)")
def t06_key_classes(spark, d):
    """Keys that carry a letter elsewhere, stand for a mark inside words, or accent the next letter."""
    sets = (KEYS, brain.Keyboards("en", ("el", "he")), brain.Keyboards("uk", ("en",)))
    rows = [(k.source, name, f(k)) for k in sets for name, f in (("letters", brain.letter_keys), ("marks", brain.inner_marks), ("accents", brain.accent_keys))]
    return spark.createDataFrame(rows, "source string, kind string, keys string")


@query(rf"select w as chunk, count(*) as n from (select unnest(regexp_extract_all(replace(text, 'the', {_text('];')}), '[^ \t\r\n]+')) as w from documents) where regexp_matches(w, {_text(rf'^[{_CARRY}]+$')}) group by 1")
def t07_letterless_chunks(spark, d):
    """Chunks without letters whose every key types one elsewhere."""
    x = F.replace("text", F.lit("the"), F.lit("];"))
    w = _docs(spark, d).select(F.explode(F.regexp_extract_all(x, F.lit(r"([^ \t\r\n]+)"), 1)).alias("chunk")).filter(F.col("chunk").rlike(rf"^[{_CARRY}]+$"))
    return w.groupBy("chunk").agg(F.count("*").alias("n"))


@query(None)
def t08_line_tokens(spark, d):
    """Words, chunks of letter keys and gaps of each text, with how many of each."""
    x = brain.tokens(_docs(spark, d).select(F.col("doc_id").alias("line_id"), "text"), KEYS)
    return x.groupBy("line_id", "kind").agg(F.count("*").alias("n"))


_ENDS = r"(select doc_id, len(c) as n, list_filter(range(1, len(c) + 1), lambda i: regexp_matches(c[i], '[.!?…]$')) as ends from (select doc_id, regexp_extract_all(text, '[^ \t\r\n]+') as c from documents))"


@query(f"""with recursive e as {_ENDS}, w as (select doc_id, n, ends, 0::bigint as f, case when n <= 24 then n else coalesce(list_max(list_filter(ends, lambda x: x > 1 and x <= 24)), 24) end::bigint as upto from e where n > 0
union all select doc_id, n, ends, upto, case when upto + 24 >= n then n else coalesce(list_max(list_filter(ends, lambda x: x > upto + 1 and x <= upto + 24)), upto + 24) end::bigint from w where upto < n) select doc_id, f as first, upto from w""")
def t10_sentence_windows(spark, d):
    """Windows of 24 chunks at most, each cut after the last sentence end in reach."""
    c = F.regexp_extract_all("text", F.lit(r"([^ \t\r\n]+)"), 1)
    return brain.windows(_docs(spark, d).select("doc_id", c.alias("chunks")), "doc_id", "chunks", 24)


@query(f"select doc_id, case when {_dominant('x')} = 'Latin' then {_read('x', B.rules(('en',), 'uk'))} else {_read('x', B.rules(('uk',), 'en'))} end as text from (select doc_id, case when doc_id % 2 = 0 then text else {_read('text', B.rules(('en',), 'uk'))} end as x from documents) where not (regexp_matches(x, '[a-zA-Z\\x{{00C0}}-\\x{{024F}}]') and regexp_matches(x, '[\\x{{0400}}-\\x{{04FF}}]'))")
def b15_plain_switches(spark, d):
    """Texts of one script moved to the other layout by their majority script, without asking any list."""
    x = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(B.transcode(F.col("text"), "en", "uk"))
    rows = _docs(spark, d).select("doc_id", x.alias("x")).filter(~(F.col("x").rlike(r"[a-zA-Z\x{00C0}-\x{024F}]") & F.col("x").rlike(r"[\x{0400}-\x{04FF}]")))
    x = F.col("x")
    return rows.select("doc_id", F.when(scripts.dominant(x) == "Latin", B.transcode(x, "en", "uk")).otherwise(B.transcode(x, "uk", "en")).alias("text"))


@query(f"select word, {_read('word', B.rules(('en',), 'uk'))} as read, length(regexp_replace(word, '[^a-z]', '', 'g')) >= 4 and word in (select word from {WORDS} where lang = 'en' and n > 1) as settled from {_SEEN}")
def b18_settled_words(spark, d):
    """Known words of four letters, which need no second look."""
    c = L.word_counts(_docs(spark, d))
    known = c.filter("lang = 'en' and n > 1").select("word").distinct().withColumn("known", F.lit(True))
    w = c.filter("lang in ('en', 'es')").select("word").distinct().join(known, "word", "left")
    settled = (F.length(F.regexp_replace("word", "[^a-z]", "")) >= 4) & F.coalesce("known", F.lit(False))
    return w.select("word", B.transcode(F.col("word"), "en", "uk").alias("read"), settled.alias("settled"))


_MOVED = f"case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then {_read('text', B.rules(('en',), 'uk'))} else {_read('text', B.rules(('en',), 'el'))} end"
_CAN = " or ".join(f"regexp_matches(x, '[{r}]')" for s, r in scripts.RANGES.items() if s not in ("Latin", "Cyrillic"))


@query(f"select doc_id, not ({_CAN}) as may from (select doc_id, {_MOVED} as x from documents)")
def f17_typable_scripts(spark, d):
    """Whether an answer is written in scripts that the writer can type (B19)."""
    x = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, B.transcode(F.col("text"), "en", "uk")).otherwise(B.transcode(F.col("text"), "en", "el"))
    return _docs(spark, d).select("doc_id", brain.only_scripts(x, ["Latin", "Cyrillic"]).alias("may"))


@query(f"select doc_id, case when s is null or s = 'Latin' then null when s = 'Cyrillic' then 'ru' when s = 'Greek' then 'el' end as target from (select doc_id, {_dominant('x')} as s from (select doc_id, {_MOVED} as x from documents))")
def b20_resolved_targets(spark, d):
    """The layout of the script that an answer moved into: the preferred one, else the first."""
    x = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, B.transcode(F.col("text"), "en", "uk")).otherwise(B.transcode(F.col("text"), "en", "el"))
    return _docs(spark, d).select("doc_id", brain.target_of(x, "Latin", ["uk", "ru", "el"], "ru").alias("target"))


@query("select doc_id, case when regexp_matches(keys, '^[a-z;,.\\[\\]'']+$') then 'en' when regexp_matches(keys, '^[а-яіїєґ]+$') then 'uk' end as source from (select doc_id, case doc_id % 3 when 0 then ';[' when 1 then 'їж' else '€' end as keys from documents)")
def b21_resolved_sources(spark, d):
    """The first installed layout that types a chunk's keys."""
    keys = F.when(F.col("doc_id") % 3 == 0, ";[").when(F.col("doc_id") % 3 == 1, "їж").otherwise("€")
    return _docs(spark, d).select("doc_id", brain.source_of(keys, ["en", "uk"]).alias("source"))


@query("select a || b as chunk, count(*) as n from (select chr(97 + i::int) as a from (select unnest(range(0, 26)) as i)), (select chr(97 + i::int) as b from (select unnest(range(0, 26)) as i)) group by 1")
def e09_two_letter_chunks(spark, d):
    """All chunks of two letters, which automatic correction must leave alone without a direction."""
    letters = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"])
    pairs = F.flatten(F.transform(letters, lambda a: F.transform(letters, lambda b: F.concat(a, b))))
    return spark.range(1).select(F.explode(pairs).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
