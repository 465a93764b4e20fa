"""Models of letters, word scores, target votes and line evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lingsmith.functions import text as X
from lingsmith.operators import lexicon as L
from lingsmith.operators import votes
from lingsmith.plans._registry import WORDS, query, t


def _counts(spark, d):
    return L.word_counts(t(spark, d, "documents"))


_FIT = f"""with k as materialized {WORDS}, c as (select *, ln(1+n) as w, unnest(range(1, length(word) + 2)) as i from k),
g as (select lang, word, w, substr('^^' || word || '$', i, 3) as tri, substr('^^' || word || '$', i, 2) as ctx from c),
tt as (select lang, tri, sum(w) as t from g group by all), cc as (select lang, ctx, sum(w) as c from g group by all),
a as (select lang, count(distinct ch) + 1 as size from (select lang, unnest(string_split(word, '')) as ch from k) group by 1),
ways as (select lang, word, n, false as back, word as s from k union all select lang, word, n, true, reverse(word) from k),
h as (select lang, word, n, back, substr('^^' || s || '$', i, 3) as tri, substr('^^' || s || '$', i, 2) as ctx from (select *, unnest(range(1, length(s) + 2)) as i from ways)),
fit as materialized (select lang, word, any_value(n) as n, back, round(avg(log10((coalesce(t, 0) + 0.5) / (coalesce(c, 0) + 0.5 * size))), 6) as fit from h left join tt using (lang, tri) left join cc using (lang, ctx) join a using (lang) group by lang, word, back),
cum as (select lang, back, fit, sum(n) over (partition by lang, back order by fit) as upto, sum(n) over (partition by lang, back) as total from fit),
med as (select lang, back, min(fit) as median from cum where upto >= total / 2 group by all),
cal as materialized (select h.lang, h.median as hi, l.median as lo from med h join med l on h.lang = l.lang and not h.back and l.back where h.median - l.median >= 0.1)"""


@query(_FIT + " select lang, back, median from med")
def a06_weighted_medians(spark, d):
    return L.weighted_medians(L.both_ways(_counts(spark, d)))


@query(_FIT + " select lang, hi, lo from cal")
def a07_calibration(spark, d):
    return L.calibration(L.weighted_medians(L.both_ways(_counts(spark, d))))


@query(_FIT + " select lang, word, round(greatest(0.0, least(1.0, (fit - lo) / (hi - lo))), 5) as score from fit join cal using (lang) where not back")
def a08_naturalness_score(spark, d):
    fits = L.both_ways(_counts(spark, d))
    cal = F.broadcast(L.calibration(L.weighted_medians(fits)))  # one row a language
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("fit") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return fits.filter("not back").join(cal, "lang").select("lang", "word", F.round(score, 5).alias("score"))


@query(f"select word, max(n) as n, round(max(least(1.0, ln(1+n) / ln(1+top))), 6) as freq from (select *, max(n) over (partition by lang) as top from {WORDS}) group by 1")
def a03_best_frequency(spark, d):
    f = L.log_frequency(_counts(spark, d))
    return f.groupBy("word").agg(F.max("n").alias("n"), F.max("freq").alias("freq"))


@query(f"select lang, sum(n)::bigint as total, count(*) as words from {WORDS} group by 1")
def a23_totals(spark, d):
    return _counts(spark, d).groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("words"))


@query(f"""with f as (select lang, word, round(least(1.0, ln(1+n) / ln(1+max(n) over (partition by lang))), 6) as freq from {WORDS}),
e as (select word, freq from f where lang = 'en'), o as (select word, max(freq) as other from f where lang <> 'en' group by 1)
select word, round(case when freq is not null then 0.95 + 0.05 * freq when other is not null then 0.92 + 0.025 * other end, 6) as score, case when freq is not null then 'own' else 'pool' end as hit from e full join o using (word)""")
def b01_list_hits(spark, d):
    """Scores of listed words for English: its own list, else any list of the script (the hit part of B01, B02)."""
    return votes.list_scores(L.log_frequency(_counts(spark, d)), "en")


@query(r"""with v as (select user_id, event_type as target, count(*) as n, bool_or(value > 100) as electing from events group by all),
r as (select *, row_number() over (partition by user_id order by n desc, electing desc, target = 'view' desc, target) as i from v) select user_id, target, n, electing from r where i = 1""")
def a10_target_votes(spark, d):
    e = t(spark, d, "events").select("user_id", F.col("event_type").alias("target"), (F.col("value") > 100).alias("electing"))
    return votes.elected(e, ["user_id"], "view")


@query(rf"""with w as (select doc_id, pos, w, (length(w) <= 3)::int as short from (select doc_id, generate_subscripts(x, 1) - 1 as pos, unnest(x) as w from (select doc_id, regexp_extract_all(text, '\p{{L}}+') as x from documents)))
select doc_id, sum((2 * (s - short) > n - 1)::int)::bigint as n_short_lines, count(*) as n from (select *, sum(short) over (partition by doc_id) as s, count(*) over (partition by doc_id) as n from w) group by 1""")
def a11_leave_one_out(spark, d):
    """Words whose line is made of short words for the most part, each judged by the others."""
    w = t(spark, d, "documents").select("doc_id", F.posexplode(X.words(F.col("text"))).alias("pos", "w")).withColumn("short", F.length("w") <= 3)
    judged = votes.others_majority(w, ["doc_id"], "short")
    return judged.groupBy("doc_id").agg(F.sum(F.col("majority").cast("int")).alias("n_short_lines"), F.count("*").alias("n"))


@query("select case when value > 150 then 'far' when value > 50 then 'near' else 'same' end as reason, count(*) as n from events group by 1")
def a15_miss_reasons(spark, d):
    reason = F.when(F.col("value") > 150, "far").when(F.col("value") > 50, "near").otherwise("same")
    return t(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""with days as (select distinct event_type, unnest(generate_series((select min(ts)::date from events), (select max(ts)::date from events), interval 1 day))::date as day from events),
c as (select event_type, ts::date as day, count(*) as n from events group by all), z as (select event_type, day, coalesce(n, 0) as n from days left join c using (event_type, day))
select event_type, strftime(day, '%Y-%m-%d') as day, sum(n) over (partition by event_type order by day rows between 6 preceding and current row)::bigint as week from z""")
def a19_rolling_usage(spark, d):
    """Totals of the last seven days, days without events included."""
    c = t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    span = c.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    days = c.select("event_type").distinct().crossJoin(F.broadcast(span))  # kinds by days of the calendar: both small by nature
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)
    return days.join(c, ["event_type", "day"], "left").fillna(0, ["n"]).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.sum("n").over(w).alias("week"))


@query("select p_brand, round(sum(p_size) / 1048576.0, 9) as mib, count(*) as files from part group by 1")
def a20_pack_sizes(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.round(F.sum("p_size") / 1048576.0, 9).alias("mib"), F.count("*").alias("files"))
