"""Word lists read, cleaned and written; lookups in them; layout keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingsmith.functions import layouts, slips
from lingsmith.functions import text as X
from lingsmith.operators import lexicon as L
from lingsmith.operators import lookup as K
from lingsmith.plans._registry import WORDS, query, t
from lingsmith.sources import lists


def _counts(spark, d):
    return L.word_counts(t(spark, d, "documents"))


def _of(spark, d, lang):
    return _counts(spark, d).filter(F.col("lang") == lang).select("word", "n")


def _part_lines(spark, d, *cols, by=" "):
    return t(spark, d, "part").select(F.concat_ws(by, *cols).alias("value"))


@query("select lower(string_split(l, ' ')[1]) as word, sum(try_cast(string_split(l, ' ')[-1] as bigint))::bigint as n from (select p_brand || ' ' || p_type || ' ' || p_size as l from part) group by 1")
def r02_last_field_lists(spark, d):
    return lists.parsed_last(_part_lines(spark, d, "p_brand", "p_type", F.col("p_size").cast("string"))).groupBy("word").agg(K.saturating_sum("n").alias("n"))


@query("select l as line from (select p_type || ' ' || case when p_partkey % 3 = 0 then '-' else '' end || p_size as l from part) where regexp_matches(string_split(l, ' ')[-1], '^[0-9]+$')")
def r03_digit_counts(spark, d):
    size = F.concat(F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(""), F.col("p_size").cast("string"))
    return lists.digits_last(t(spark, d, "part").select(F.concat_ws(" ", "p_type", size).alias("value"))).withColumnRenamed("value", "line")


@query("select split_part(p_type || chr(9) || p_name || chr(9) || p_brand, chr(9), 2) as form from part")
def r08_second_column(spark, d):
    return lists.tab_column(_part_lines(spark, d, "p_type", "p_name", "p_brand", by="\t"), 1).withColumnRenamed("field", "form")


@query("select doc_id, count(*) as lines from (select doc_id, trim(unnest(string_split(case when doc_id % 4 = 0 then '# ' || text else text end, chr(10))), ' ' || chr(9) || chr(13)) as l from documents) where l <> '' and not starts_with(l, '#') group by 1")
def r11_data_lines(spark, d):
    x = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    lines = t(spark, d, "documents").select("doc_id", F.explode(F.split(x, "\n", -1)).alias("value"))
    return lists.data_lines(lines).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("select event_id, 'k' as metric, try_cast(props->>'$.k' as double) as value from events where props->>'$.k' is not null")
def r13_metric_maps(spark, d):
    return lists.metrics(t(spark, d, "events"), "props", ["event_id"])


@query(f"""select lang, sum(n) filter (why = 'kept')::bigint as kept, coalesce(sum(n) filter (why = 'short'), 0)::bigint as short, coalesce(sum(n) filter (why = 'letters'), 0)::bigint as letters, coalesce(sum(n) filter (why = 'neighbour'), 0)::bigint as neighbour from
(select lang, n, case when not regexp_matches(word, '^[a-zäöüßàâçéèêëîïôûùüÿñæœáíóú]+$') then 'letters' when length(word) < 2 then 'short' when lang <> 'en' and word in (select word from {WORDS} where lang = 'en') then 'neighbour' else 'kept' end as why from {WORDS}) group by 1""")
def r05_list_statistics(spark, d):
    """What of each list stays and what goes, by reason (F05, F06: words of a neighbouring language go)."""
    c = _counts(spark, d)
    english = c.filter("lang = 'en'").select("word", F.lit(True).alias("english"))
    why = (
        F.when(~F.col("word").rlike("^[a-zäöüßàâçéèêëîïôûùüÿñæœáíóú]+$"), "letters")
        .when(F.length("word") < 2, "short")
        .when((F.col("lang") != "en") & F.col("english"), "neighbour")
        .otherwise("kept")
    )
    marked = c.join(english, "word", "left").withColumn("why", why)
    part = lambda w: F.sum(F.when(F.col("why") == w, F.col("n")).otherwise(0)).alias(w)
    return marked.groupBy("lang").agg(*map(part, ["kept", "short", "letters", "neighbour"]))


@query(f"select lang, word || ' ' || n as line from {WORDS} where length(word) > 2 and n > 1")
def k01_list_rewritten(spark, d):
    return _counts(spark, d).filter("length(word) > 2 and n > 1").select("lang", lists.as_line("word", "n").alias("line"))


@query(f"select lang, word, n from (select *, row_number() over (partition by lang order by n desc, word) as r from {WORDS}) where r <= 50 or word in ('of', 'die', 'que')")
def k05_fixture_lists(spark, d):
    """The commonest words of each language and some named ones."""
    c = _counts(spark, d)
    top = L.top_words(c, 50).select("lang", "word", "n")
    return top.union(c.filter(F.col("word").isin("of", "die", "que"))).distinct()


@query("select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events where ts::date > (select max(ts)::date from events) - 10 group by all")
def k06_pruned_days(spark, d):
    """Daily counters of the last ten days."""
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    last = F.broadcast(e.agg(F.max("day").alias("last")))  # one row
    return e.join(last, F.col("day") > F.date_sub("last", 10)).groupBy("event_type", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"select e.word, coalesce(f.n, 0)::bigint as n from (select word from {WORDS} where lang = 'en') e left join (select word, n from {WORDS} where lang = 'de') f using (word)")
def j01_exact_lookup(spark, d):
    return K.known(_of(spark, d, "en").select("word"), _of(spark, d, "de"))


@query(f"select distinct word from {WORDS} where lang = 'en' and word in (select word from {WORDS} where lang <> 'en')")
def j02_known_in_pool(spark, d):
    c = _counts(spark, d)
    return c.filter("lang = 'en'").select("word").join(c.filter("lang <> 'en'").select("word"), "word", "left_semi")


@query(f"select word, arg_min(lang, case lang when 'en' then 0 when 'de' then 1 when 'es' then 2 else 3 end) as first_list from {WORDS} group by 1")
def j03_first_list(spark, d):
    """The first list that has a word: own language first, then the others."""
    place = F.array_position(F.array(*map(F.lit, ["en", "de", "es", "fr"])), F.col("lang"))
    return _counts(spark, d).groupBy("word").agg(F.min_by("lang", place).alias("first_list"))


@query(f"select word, count(distinct lang) as lists from (select lang, unnest([word, translate(word, 'äöü', 'aou')]) as word from {WORDS} where length(word) >= 4) group by 1")
def j04_lexicon_variants(spark, d):
    """Words of four letters or more under each of their spellings."""
    variants = F.explode(F.array_distinct(F.array("word", F.translate("word", "äöü", "aou")))).alias("word")
    return _counts(spark, d).filter("length(word) >= 4").select("lang", variants).groupBy("word").agg(F.count_distinct("lang").alias("lists"))


def _slips(counts):
    """Words with their second letter left out, where that is no word of the same list (the reference looks up no known word)."""
    cut = counts.filter("length(word) >= 3").select("lang", F.expr("concat(substring(word, 1, 1), substring(word, 3))").alias("word")).distinct()
    return cut.join(counts.select("lang", "word"), ["lang", "word"], "left_anti")


@query(None)
def j05_fuzzy_lookup(spark, d):
    """The nearest words of each list within two edits of each slip; the 100,000 commonest words of a list are indexed."""
    c = _counts(spark, d)
    return L.nearest(_slips(c), L.top_words(c, 100_000), by=["lang"])


@query(None)
def j06_best_correction(spark, d):
    """One correction of each slip, over the lists of all languages, its own language's before others."""
    c = _counts(spark, d)
    return K.corrections(_slips(c), L.log_frequency(c).select("lang", "word", "freq"))


@query(None)
def j07_suggestions(spark, d):
    c = _counts(spark, d)
    return K.suggestions(_slips(c), c, 12)


@query(None)
def x30_slip_costs(spark, d):
    """Slips and their nearest words with what the slip costs on the US keyboard."""
    c = _counts(spark, d)
    pairs = L.nearest(_slips(c), c, by=["lang"])
    return pairs.select("lang", "typed", "word", F.round(slips.typo_cost(F.col("typed"), F.col("word"), "en"), 6).alias("cost"))


@query(f"select lang, word, swapped, (word <> swapped)::int as dist from (select lang, word, substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4) as swapped from {WORDS} where length(word) >= 3)")
def x31_swap_distance(spark, d):
    """Words and the same words with two letters swapped: one edit, or none where they are equal."""
    w = _counts(spark, d).filter("length(word) >= 3").select("lang", "word", X.swapped(F.col("word"), F.lit(2)).alias("swapped"))
    return w.withColumn("dist", slips.osa(F.col("word"), F.col("swapped")))


_A = "(select * from (values (0, 'th', ''), (1, 're', ''), (2, '', 'ed'), (3, '', 'ing')) v(i, p, s))"


@query(f"with w as (select word from {WORDS} where lang = 'en'), c as (select w.word, i, substr(w.word, length(p) + 1, length(w.word) - length(p) - length(s)) as stem from w, {_A} where starts_with(w.word, p) and ends_with(w.word, s)) select word, arg_min(stem, i) as stem from c where length(stem) >= 3 and stem in (select word from w) group by 1")
def j08_affix_stems(spark, d):
    w = _of(spark, d, "en")
    return K.stems(w.select("word"), w, ["th", "re"], ["ed", "ing"], 3)


@query(f"select p_partkey, layout, case layout when 'ru' then translate(p_name, $a${layouts.pairs('ru')[0]}$a$, $b${layouts.pairs('ru')[1]}$b$) when 'uk' then translate(p_name, $a${layouts.pairs('uk')[0]}$a$, $b${layouts.pairs('uk')[1]}$b$) else translate(p_name, $a${layouts.pairs('el')[0]}$a$, $b${layouts.pairs('el')[1]}$b$) end as reading from part, (select unnest(['ru', 'uk', 'el']) as layout)")
def j10_readings(spark, d):
    """Each name as each layout reads its keys: an explode over the layouts, no join."""
    ways = F.array(*[F.struct(F.lit(k).alias("layout"), layouts.transcode(F.col("p_name"), k).alias("reading")) for k in ("ru", "uk", "el")])
    return t(spark, d, "part").select("p_partkey", F.explode(ways).alias("r")).select("p_partkey", "r.layout", "r.reading")


_RATE = "(select event_type, user_id % 10 as g, avg((value > 50)::int) as v from events where {} group by all)"


@query(f"select coalesce(b.event_type, n.event_type) as event_type, coalesce(b.g, n.g) as g, case when b.v is null then 'new' when n.v is null then 'gone' when n.v - b.v > 0.005 then 'better' when n.v - b.v < -0.005 then 'worse' when abs(n.v - b.v) > 0.0005 then 'moved' else 'same' end as state from {_RATE.format('event_id % 2 = 0')} b full join {_RATE.format('event_id % 2 = 1')} n on b.event_type = n.event_type and b.g = n.g")
def e13_baseline_compare(spark, d):
    """Rates of one half of the events against those of the other (J15)."""
    rate = lambda half: t(spark, d, "events").filter(F.col("event_id") % 2 == half).groupBy("event_type", (F.col("user_id") % 10).alias("g")).agg(F.avg((F.col("value") > 50).cast("int")).alias("v"))
    return K.moved(rate(0), rate(1), ["event_type", "g"], "v", 0.005, 0.0005)


def _keys_sql() -> str:
    return ", ".join(f"('{c.replace(chr(39), 2 * chr(39))}', {r}, {x})" for c, r, x in layouts.positions())


@query(f"with k as (select * from (values {_keys_sql()}) v(ch, r, x)) select a.ch as a, b.ch as b from k a, k b where a.ch <> b.ch and abs(a.r - b.r) <= 1 and abs(a.x - b.x) <= 1.0")
def s16_neighbouring_keys(spark, d):
    return K.neighbours(spark.createDataFrame(layouts.positions(), "ch string, row int, x double"))


@query(f"select word, word || repeat(right(word, 1), 1) as doubled, substr(word, 1, 1) || substr(word, 3) as dropped, substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4) as swapped from (select distinct word from {WORDS})")
def e03_typos(spark, d):
    """Slips at fixed places: the last letter doubled, the second dropped, the second and third swapped (E04)."""
    w = F.col("word")
    return _counts(spark, d).select("word").distinct().select("word", F.concat(w, F.right(w, F.lit(1))).alias("doubled"), F.expr("concat(substring(word, 1, 1), substring(word, 3))").alias("dropped"), X.swapped(w, F.lit(2)).alias("swapped"))


@query(f"with c as (select word, n, (sum(n) over (order by n desc, word rows unbounded preceding) - n)::bigint as lo, sum(n) over ()::bigint as total from {WORDS} where lang = 'fr'), p as (select unnest(range(0, 50)) as i) select i, word from p, c where (i * 7919 + 13) % total >= lo and (i * 7919 + 13) % total < lo + n")
def o09_weighted_picks(spark, d):
    """Words by fixed places in their cumulative counts (E01)."""
    return L.picked(_of(spark, d, "fr"), 50)
