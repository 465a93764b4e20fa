"""Operators over events in order, in their batch forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lingsmith.plans._registry import query, t
from lingsmith.streaming import keys, state

_W = "window w as (partition by user_id order by ts, event_id)"


def _events(spark, d):
    return t(spark, d, "events")


@query(f"""with q as (select *, coalesce(lag(event_type) over w = event_type and ts - lag(ts) over w <= interval 10 minute, false) as quick from events {_W}),
r as (select *, sum((not quick)::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from q),
p as (select *, row_number() over (partition by user_id, run order by ts, event_id) as place from r) select event_id from p where quick and place % 2 = 0""")
def m03_double_taps(spark, d):
    return state.double_taps(_events(spark, d), 600_000_000).select("event_id")


@query(f"""with c as (select *, coalesce((ts - lag(ts) over w >= interval 300 second or lag(event_type) over w = 'purchase')::int, 0) as cut from events {_W}),
l as (select *, sum(cut) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as line from c),
k as (select user_id, line, list(event_type order by ts, event_id) as k, max(event_id) as last_id from l where event_type <> 'purchase' group by all)
select user_id, line, last_id, list_reduce(list_prepend('', list_transform(k, lambda x: case when x = 'error' then '<' else x[1] end)), lambda a, b: case when b = '<' then a[:greatest(length(a) - 1, 0)] else a || b end) as typed from k""")
def m01_typed_buffers(spark, d):
    """Events as keys: purchase ends a line, error takes a key back."""
    return state.typed_buffers(_events(spark, d), 300, "purchase", "error")


@query(f"select event_id, case when running and (not want or not granted) then 'stop' when running and gap > 6 * 3600 * 1000 then 'restart' when not running and want and granted then 'start' else 'none' end as action from (select event_id, event_type <> 'error' as want, event_type in ('view', 'click', 'error') as running, value < 150 as granted, coalesce((epoch_us(ts) - epoch_us(lag(ts) over w)) / 1000.0, 0) as gap from events {_W})")
def m07_watchdog(spark, d):
    kind = F.col("event_type")
    gap = F.coalesce(keys.gap_us() / 1000, F.lit(0.0))
    x = _events(spark, d).select("event_id", "value", "event_type", gap.alias("gap"))
    return x.select("event_id", state.watchdog(kind != "error", kind.isin("view", "click", "error"), F.col("value") < 150, F.col("gap"), 2 * 3600 * 1000).alias("action"))


@query("""with recursive e as (select user_id, event_id, value / 1000.0 as level, row_number() over (partition by user_id order by ts, event_id) as i from events),
r as (select user_id, event_id, level, i, level as peak from e where i = 1 union all select e.user_id, e.event_id, e.level, e.i, greatest(e.level, 0.993::double * r.peak) from r join e on e.user_id = r.user_id and e.i = r.i + 1)
select event_id, level >= greatest(0.01, 0.2 * peak) as loud from r""")
def m09_adaptive_loudness(spark, d):
    x = _events(spark, d).withColumn("level", F.col("value") / 1000)
    return state.loud(x, "user_id", ["ts", "event_id"], "level").select("event_id", "loud")


@query("select * from (select user_id, strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as hour, round(sqrt(avg(value * value)), 6) as rms from events group by all) qualify row_number() over (partition by user_id order by rms desc, hour) = 1")
def m10_loudest_window(spark, d):
    """Each user's tumbling hour with the greatest root mean square."""
    rms = F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6)
    x = _events(spark, d).groupBy("user_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm").alias("hour")).agg(rms.alias("rms"))
    return x.groupBy("user_id").agg(F.min(F.struct((-F.col("rms")).alias("m"), "hour", "rms")).alias("b")).select("user_id", "b.hour", "b.rms")


@query(f"select event_id from (select event_id, event_type, max(case when event_type = 'signup' then event_id end) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as later from events) where event_type = 'view' and later is null")
def m12_current_epoch(spark, d):
    """Views that no later signup of the same user has made stale."""
    later = F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(keys.by_user().rowsBetween(1, Window.unboundedFollowing))
    return _events(spark, d).withColumn("later", later).filter("event_type = 'view' and later is null").select("event_id")


@query("select user_id, string_agg(event_id::varchar, ' ' order by ts desc, event_id desc) as newest_first from (select *, max(ts) over (partition by user_id) as last from events) where last - ts < interval 30 minute group by 1")
def m15_history(spark, d):
    """What each user did in the half hour before their last event, newest first."""
    last = F.max("ts").over(Window.partitionBy("user_id"))
    age = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    x = _events(spark, d).withColumn("last", last).filter(age < 1_800_000_000)
    ids = F.reverse(F.array_sort(F.collect_list(F.struct("ts", "event_id"))))
    return x.groupBy("user_id").agg(F.array_join(F.transform(ids, lambda s: s["event_id"].cast("string")), " ").alias("newest_first"))


@query("""with f as (select *, case when value < 100 then event_type end as layout from events), k as (select *, last_value(layout ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as now from f),
c as (select *, lag(now) over (partition by user_id order by ts, event_id) as was from k) select event_id, now as layout from c where now is distinct from was and was is not null""")
def m16_layout_changes(spark, d):
    """Events at which the layout changes; where it is unknown the one before holds."""
    layout = F.when(F.col("value") < 100, F.col("event_type"))
    now = F.last(layout, ignorenulls=True).over(keys.by_user().rowsBetween(Window.unboundedPreceding, 0))
    x = _events(spark, d).withColumn("now", now)
    x = x.withColumn("was", F.lag("now").over(keys.by_user()))
    return x.filter(~F.col("now").eqNullSafe(F.col("was")) & F.col("was").isNotNull()).select("event_id", F.col("now").alias("layout"))


_MARKED = r"(select doc_id, generate_subscripts(x, 1) - 1 as pos, unnest(x) as w from (select doc_id, regexp_extract_all(text, '\p{L}+') as x from documents))"


@query(f"select doc_id, pos, case when last_value(case when length(w) % 7 = 0 then 'across' when length(w) >= 3 then 'none' end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) = 'across' then 'across' end as direction from {_MARKED}")
def m04_sticky_direction(spark, d):
    """The direction that automatic correction has before each word of a text."""
    w = t(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("pos", "w"))
    n = F.length("w")
    marked = w.select("doc_id", F.col("pos").cast("long").alias("pos"), (n % 7 == 0).alias("crossed"), ((n % 7 != 0) & (n >= 3)).alias("settled"))
    return state.sticky_direction(marked, ["doc_id"]).select("doc_id", "pos", "direction")


def _ring(d_sql: bool = False):
    from lingsmith.functions import keyboards as B

    return [B.transcode(F.col("p_name"), "en", n) for n in ("uk", "ru", "bg")]


def _ring_sql() -> str:
    from lingsmith.functions import keyboards as B
    from lingsmith.plans.keyboards import _read

    uk, ru, bg = (_read("p_name", B.rules(("en",), n)) for n in ("uk", "ru", "bg"))
    return f"(select p_partkey, p_name, list_filter([case when uk <> p_name then uk end, case when ru not in (uk, p_name) then ru end, case when bg not in (uk, ru, p_name) then bg end, p_name], lambda x: x is not null) as ring from (select p_partkey, p_name, {uk} as uk, {ru} as ru, {bg} as bg from part))"


def _rings(spark, d):
    x = F.array_distinct(F.array(*_ring()))
    return t(spark, d, "part").select("p_partkey", "p_name", F.array_append(F.filter(x, lambda r: r != F.col("p_name")), F.col("p_name")).alias("ring"))


@query(f"select p_partkey, presses, ring[(presses - 1) % len(ring) + 1] as shown from {_ring_sql()}, (select unnest(range(1, 11)) as presses)")
def m05_hotkey_ring(spark, d):
    """What ten presses of the hotkey show: each distinct reading, then the original, and round again."""
    press = F.explode(F.sequence(F.lit(1), F.lit(10))).alias("presses")
    shown = F.element_at("ring", ((F.col("presses") - 1) % F.size("ring") + 1).cast("int"))
    return _rings(spark, d).select("p_partkey", "ring", press).select("p_partkey", F.col("presses").cast("long").alias("presses"), shown.alias("shown"))


@query(f"select p_partkey, true as comes_back, len(ring) = len(list_distinct(ring)) as no_repeats from {_ring_sql()}")
def e16_circle_comes_back(spark, d):
    """As many presses as the ring has readings come back to the original, and no reading comes twice."""
    return _rings(spark, d).select("p_partkey", (F.element_at("ring", -1) == F.col("p_name")).alias("comes_back"), (F.size("ring") == F.size(F.array_distinct("ring"))).alias("no_repeats"))


@query(f"select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as rejections, row_number() over (partition by user_id order by ts, event_id) >= 3 as listed from (select *, event_type = 'error' and lag(event_type) over w = 'purchase' and ts - lag(ts) over w <= interval 20000 second as hit from events {_W}) where hit")
def m06_fixes_undone(spark, d):
    return state.undone(_events(spark, d), "purchase", "error", 20_000, 3)


@query(None)
def m08_dictation_parts(spark, d):
    return state.parts(_events(spark, d), 7200, 2400, 36_000, 86_400)


@query(f"select event_id, case when held is null or held >= interval 1800 second then 'hold' when nxt = 'view' then 'tap' else 'spoiled' end as chord from (select event_id, event_type, lead(event_type) over w as nxt, lead(ts) over w - ts as held from events {_W}) where event_type = 'click'")
def m17_held_chords(spark, d):
    return state.chords(_events(spark, d), "click", "view", 1_800_000_000)


@query(None)
def m18_pending_tails(spark, d):
    return state.tails(_events(spark, d), "purchase", "error")
