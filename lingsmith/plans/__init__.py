"""The queries over the supplied tables and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lingsmith.functions import layouts, scripts
from lingsmith.functions import text as X
from lingsmith.operators import lexicon as L
from lingsmith.plans._registry import ORACLES, QUERIES, WORDS as _WORDS, query, t  # noqa: F401
from lingsmith.sources import lists
from lingsmith.streaming import keys

_R = {k: v for k, v in scripts.RANGES.items()}


def _len(s: str, col: str = "text") -> str:
    return f"length(regexp_replace({col}, '[^{_R[s]}]', '', 'g'))"


@query(f"select lang, word, n from {_WORDS}")
def a01_word_counts(spark, d):
    return L.word_counts(t(spark, d, "documents"))


@query(f"select lang, word, n, round(least(1.0, ln(1+n)/ln(1+max(n) over (partition by lang))), 6) as freq from {_WORDS}")
def a02_log_frequency(spark, d):
    return L.log_frequency(L.word_counts(t(spark, d, "documents")))


@query(f"with c as (select lang, word, n, round(least(1.0, ln(1+n)/ln(1+max(n) over (partition by lang))), 6) as freq, row_number() over (partition by lang order by n desc, word) as rank from {_WORDS}) select * from c where rank <= 100")
def o01_top_words(spark, d):
    return L.top_words(L.log_frequency(L.word_counts(t(spark, d, "documents"))), 100)


@query(f"with c as (select lang, word, n, row_number() over (partition by lang order by n desc, word) - 1 as i from {_WORDS}) select * from c where i > 500 and i % 7 = 0")
def o07_held_out(spark, d):
    return L.held_out(L.word_counts(t(spark, d, "documents")), 7, 500)


@query(f"with c as (select lang, word, n, row_number() over (partition by lang order by n desc, word) - 1 as i from {_WORDS}) select lang, word from c except select lang, word from c where i > 500 and i % 7 = 0")
def j11_without_held_out(spark, d):
    c = L.word_counts(t(spark, d, "documents"))
    return c.join(L.held_out(c, 7, 500), ["lang", "word"], "left_anti").select("lang", "word")


@query(f"with c as (select *, unnest(range(1, length(word) + 2)) as i from {_WORDS}) select lang, substr('^^' || word || '$', i, 3) as tri, round(sum(ln(1+n)), 4) as weight from c group by all")
def a04_trigrams(spark, d):
    return L.trigrams(L.word_counts(t(spark, d, "documents")))


@query(f"""with k as {_WORDS}, c as (select *, ln(1+n) as w, unnest(range(1, length(word) + 2)) as i from k),
g as (select lang, word, w, substr('^^' || word || '$', i, 3) as tri, substr('^^' || word || '$', i, 2) as ctx from c),
tt as (select lang, tri, sum(w) as t from g group by all), cc as (select lang, ctx, sum(w) as c from g group by all),
a as (select lang, count(distinct ch) + 1 as size from (select lang, unnest(string_split(word, '')) as ch from k) group by 1)
select g.lang, word, round(avg(log10((t + 0.5) / (c + 0.5 * size))), 5) as fit from g join tt using (lang, tri) join cc using (lang, ctx) join a using (lang) group by all""")
def a05_naturalness(spark, d):
    return L.naturalness(L.word_counts(t(spark, d, "documents")))


@query("select doc_id, generate_subscripts(w, 1) - 1 as pos, unnest(w) as chunk from (select doc_id, regexp_extract_all(text, '[^ \\t\\n]+') as w from documents)")
def t01_chunks(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([^ \\t\\n]+)"), 1)).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


@query(r"select doc_id, len(regexp_extract_all(text, '\p{L}+')) as n_words from documents")
def t03_words(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"))


@query(r"select conv_id, turn, len(regexp_extract_all(text, '[^.!?…]+[.!?…]*')) as n_sentences from conversations")
def t11_sentences(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit("([^.!?…]+[.!?…]*)"), 1)).cast("long").alias("n_sentences"))


@query(r"select conv_id, turn, lower(w) as word from (select conv_id, turn, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')) as w from conversations)")
def t13_eval_words(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*)"), 1)).alias("w")).select("conv_id", "turn", F.lower("w").alias("word"))


_RU = layouts.pairs("ru")
_MIXED = f"(select doc_id, text as t0, case doc_id % 3 when 0 then text when 1 then translate(text, $a${_RU[0]}$a$, $b${_RU[1]}$b$) else substr(text, 1, 40) || translate(substr(text, 41), $a${_RU[0]}$a$, $b${_RU[1]}$b$) end as text from documents)"


def _mixed(spark, d):
    """Documents as typed: on the right layout, on another, or with a change of layout."""
    x = F.col("text")
    moved = F.concat(F.substring(x, 1, 40), layouts.transcode(F.expr("substring(text, 41)"), "ru"))
    return t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, x).when(F.col("doc_id") % 3 == 1, layouts.transcode(x, "ru")).otherwise(moved).alias("text"))


@query(f"select doc_id, case when greatest({', '.join(_len(s) for s in _R)}) = 0 then null " + " ".join(f"when {_len(s)} = greatest({', '.join(_len(x) for x in _R)}) then '{s}'" for s in _R) + f" end as script from {_MIXED}")
def s02_dominant_script(spark, d):
    return _mixed(spark, d).select("doc_id", scripts.dominant(F.col("text")).alias("script"))


@query(f"select doc_id, {' + '.join(f'''regexp_matches(text, '[{r}]')::int''' for r in _R.values())} as n_scripts from {_MIXED}")
def s04_scripts_seen(spark, d):
    return _mixed(spark, d).select("doc_id", scripts.scripts_seen(F.col("text")).alias("n_scripts"))


@query(f"select doc_id, translate(text, $a${_RU[0]}$a$, $b${_RU[1]}$b$) as typed from documents")
def l03_transcode(spark, d):
    return t(spark, d, "documents").select("doc_id", layouts.transcode(F.col("text"), "ru").alias("typed"))


@query(f"select doc_id, translate(translate(text, $a${_RU[0]}$a$, $b${_RU[1]}$b$), $b${_RU[1]}$b$, $a${_RU[0]}$a$) as back from documents")
def e02_round_trip(spark, d):
    x = F.col("text")
    return t(spark, d, "documents").select("doc_id", layouts.transcode(layouts.transcode(x, "ru"), "ru", back=True).alias("back"))


@query(r"select doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g')) as text from documents")
def x16_normalised(spark, d):
    return t(spark, d, "documents").select("doc_id", X.normalised(F.col("text")).alias("text"))


@query("select p_partkey, translate(lower(p_name), 'aeiou', '') as skeleton from part")
def x26_skeleton(spark, d):
    return t(spark, d, "part").select("p_partkey", X.skeleton(F.col("p_name")).alias("skeleton"))


@query(r"select w as word, case when regexp_matches(w, '^\p{Ll}\p{Lu}{4,}$') then 'caps' else 'double' end as slip, count(*) as n from (select unnest(regexp_extract_all(text, '\p{L}+')) as w from documents) where regexp_matches(w, '^\p{Ll}\p{Lu}{4,}$') or (regexp_matches(w, '^\p{Lu}{2}\p{Ll}+$') and not (w like '%s' and length(w) = 3)) group by all")
def f15_caps_slips(spark, d):
    w = t(spark, d, "documents").select(F.explode(X.words(F.col("text"))).alias("word"))
    return w.withColumn("slip", X.caps_slip(F.col("word"))).filter("slip is not null").groupBy("word", "slip").agg(F.count("*").alias("n"))


@query(r"select conv_id, turn, case when regexp_matches(text, '^\p{Lu}\p{Ll}+') then lower(substr(text, 1, 1)) || substr(text, 2) else text end as text from conversations")
def x15_decapitalised(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", X.decapitalised(F.col("text")).alias("text"))


@query(f"with e as (select word, n from {_WORDS} where lang = 'en'), f as (select word, n from {_WORDS} where lang = 'fr') select word, e.n as n, round(e.n / (coalesce(f.n, 0) + 1.0), 6) as ratio from e left join f using (word) where e.n >= 20 and e.n / (coalesce(f.n, 0) + 1.0) >= 5")
def e14_neighbour_mining(spark, d):
    c = L.word_counts(t(spark, d, "documents"))
    e, f = c.filter("lang = 'en'").select("word", "n"), c.filter("lang = 'fr'").select("word", F.col("n").alias("m"))
    ratio = F.col("n") / (F.coalesce("m", F.lit(0)) + 1.0)
    return e.join(f, "word", "left").filter((F.col("n") >= 20) & (ratio >= 5)).select("word", "n", F.round(ratio, 6).alias("ratio"))


@query("with g as (select *, coalesce((ts - lag(ts) over w >= interval 60 second)::int, 0) as new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from g) select user_id, session, count(*) as n from s group by all")
def m02_sessions(spark, d):
    return keys.sessions(t(spark, d, "events"), 60)


@query("select event_id from (select event_id, event_type, ts, lag(event_type) over w as p, lag(ts) over w as q from events window w as (partition by user_id order by ts, event_id)) where p = event_type and ts - q <= interval 2 minute")
def m11_continuation(spark, d):
    e = t(spark, d, "events").withColumn("p", F.lag("event_type").over(keys.by_user())).withColumn("gap", keys.gap_us())
    return e.filter((F.col("p") == F.col("event_type")) & (F.col("gap") <= 120_000_000)).select("event_id")


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by all")
def m13_newest(spark, d):
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all")
def m14_daily_usage(spark, d):
    return t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("select event_type, user_id % 4 as bucket, count(*) as n, sum((value > 50)::int)::bigint as hits from events group by grouping sets ((event_type), (user_id % 4), ())")
def a14_two_way_tally(spark, d):
    e = t(spark, d, "events").withColumn("bucket", F.col("user_id") % 4)
    return e.groupingSets([["event_type"], ["bucket"], []], "event_type", "bucket").agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("value") > 50).cast("int")), F.lit(0)).alias("hits")).select("event_type", "bucket", "n", "hits")


@query("select event_type, quantile_disc(value, 0.5) as median, quantile_disc(value, 0.95) as p95, max(value) as top from events group by 1")
def a16_percentiles(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("median"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.max("value").alias("top"))


@query("select user_id, count(*) as n from events where event_type = 'error' group by 1 having count(*) >= 3")
def a22_rejections(spark, d):
    return t(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 3")


@query("select p_brand, round(sum(levenshtein(p_name, p_type))::double / sum(length(p_name)), 6) as cer from part group by 1")
def a17_cer(spark, d):
    rate = F.sum(F.levenshtein("p_name", "p_type")) / F.sum(F.length("p_name"))
    return t(spark, d, "part").groupBy("p_brand").agg(F.round(rate, 6).alias("cer"))


@query(f"select lang, word, sum(n) over (partition by lang order by n desc, word rows unbounded preceding)::bigint as upto from {_WORDS}")
def o08_cumulative(spark, d):
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)
    return L.word_counts(t(spark, d, "documents")).select("lang", "word", F.sum("n").over(w).alias("upto"))


@query("select split_part(l, ' ', 1) as word, try_cast(split_part(l, ' ', 2) as bigint) as n from (select p_brand || ' ' || case when p_partkey % 5 = 0 then 'x' else p_size::varchar end as l from part) where try_cast(split_part(l, ' ', 2) as bigint) > 0")
def r01_list_lines(spark, d):
    size = F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("p_size").cast("string"))
    return lists.parsed(t(spark, d, "part").select(F.concat_ws(" ", "p_brand", size).alias("value")))


@query(f"select distinct word from {_WORDS} where lang = 'en' union select distinct word from {_WORDS} where lang = 'de'")
def u01_union(spark, d):
    c = L.word_counts(t(spark, d, "documents"))
    return c.filter("lang = 'en'").select("word").union(c.filter("lang = 'de'").select("word")).distinct()


@query(f"select word from {_WORDS} where lang = 'es' except select word from {_WORDS} where lang = 'fr'")
def u04_difference(spark, d):
    c = L.word_counts(t(spark, d, "documents"))
    return c.filter("lang = 'es'").select("word").subtract(c.filter("lang = 'fr'").select("word"))


@query(f"select word from {_WORDS} where lang = 'es' intersect select word from {_WORDS} where lang = 'fr'")
def u05_intersection(spark, d):
    c = L.word_counts(t(spark, d, "documents"))
    return c.filter("lang = 'es'").select("word").intersect(c.filter("lang = 'fr'").select("word"))


@query("select doc_id, pos, line from (select doc_id, pos, line, lag(line) over (partition by doc_id order by pos) as p from (select doc_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))) where p is distinct from line")
def o11_loops_removed(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    return x.withColumn("p", F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos"))).filter(~F.col("p").eqNullSafe(F.col("line"))).select("doc_id", "pos", "line")


from lingsmith.plans import brain, files, keyboards, lookups, models, stateful, texts, transforms, words  # noqa: E402, F401  (each registers its queries)
