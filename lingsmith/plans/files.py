"""Lines of list files read and written, packs of files, orders of catalogs, names of models and devices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lingsmith.functions import models as M
from lingsmith.operators import catalog
from lingsmith.operators import lexicon as L
from lingsmith.plans._registry import WORDS, query, t
from lingsmith.sources import lists


def _docs(spark, d):
    return t(spark, d, "documents")


def _counts(spark, d):
    return L.word_counts(_docs(spark, d))


def _lines(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("value"))


_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as value from documents)"


@query("select p_brand, bool_or(coalesce(try_cast(string_split(l, ' ')[2] as bigint) > 0, false)) as word_list from (select p_brand, p_brand || ' ' || case when p_partkey % 5 < 4 then 'x' else p_size::varchar end as l from part) group by 1")
def r04_is_word_list(spark, d):
    """Whether any line of a file parses as a word with a count, file by file."""
    size = F.when(F.col("p_partkey") % 5 < 4, "x").otherwise(F.col("p_size").cast("string"))
    lines = t(spark, d, "part").select("p_brand", F.concat_ws(" ", "p_brand", size).alias("value"))
    return lists.any_counts(lines, ["p_brand"], "word_list")


@query(f"select lang, count(distinct word) as forms from (select lang, string_split(word || '/' || n, '/')[1] as word from {WORDS} where n > 1) group by 1")
def r06_lexicon_forms(spark, d):
    """Forms of expanded lexicons: a count line first, then forms with flags after a slash."""
    body = _counts(spark, d).filter("n > 1").select("lang", F.concat_ws("/", "word", F.col("n").cast("string")).alias("value"))
    head = body.groupBy("lang").agg(F.count("*").cast("string").alias("value"))
    return lists.lexicon_forms(head.union(body), ["lang"]).groupBy("lang").agg(F.count_distinct("form").alias("forms"))


@query("select distinct form from (select role || conv_id as form from conversations union all select role || conv_id || 's' || turn from conversations where turn % 3 <> 0)")
def r07_json_forms(spark, d):
    """Words and their forms from JSON lines; forms that only name a class are left out."""
    c = t(spark, d, "conversations")
    word = F.concat("role", F.col("conv_id").cast("string"))
    form = F.struct(F.concat(word, F.lit("s"), F.col("turn").cast("string")).alias("form"), F.array(F.when(F.col("turn") % 3 == 0, "class").otherwise("plural")).alias("tags"))
    return lists.forms_of_json(c.select(F.to_json(F.struct(word.alias("word"), F.array(form).alias("forms"))).alias("value")))


_CASES = "(select case when doc_id % 7 = 0 then '# note' when doc_id % 11 = 0 then '' else lang || chr(9) || source || chr(9) || case when doc_id % 2 = 0 then 'ok' else 'pending' end || case when doc_id % 3 = 0 then chr(9) || 'note' else '' end end as l from documents)"


@query(f"select f[1] as typed, f[2] as expected, f[3] as status, f[4] as note, count(*) as n from (select string_split(l, chr(9)) as f from {_CASES} where l <> '' and not starts_with(l, '#')) group by all")
def r09_case_lines(spark, d):
    """Cases of typed and expected text: tab-separated, comments and empty lines skipped, the note optional."""
    x = F.col("doc_id")
    line = F.concat_ws("\t", "lang", "source", F.when(x % 2 == 0, "ok").otherwise("pending"), F.when(x % 3 == 0, "note"))
    rows = _docs(spark, d).select(F.when(x % 7 == 0, "# note").when(x % 11 == 0, "").otherwise(line).alias("value"))
    return lists.cases(rows).groupBy("typed", "expected", "status", "note").agg(F.count("*").alias("n"))


@query("select lang, string_agg(word, ' ' order by word) as words from (select lang, source || '-' || lang as word from documents group by all) group by 1")
def r10_extra_words(spark, d):
    """Extra words by language from lines with two fields at least."""
    rows = _docs(spark, d).select("lang", "source").distinct().select(F.concat_ws("\t", "lang", F.concat_ws("-", "source", "lang"), F.lit("why")).alias("value"))
    return lists.extras(rows).select(F.col("code").alias("lang"), F.array_join("words", " ").alias("words"))


@query(f"select doc_id % 4 as list, lower(trim(value, ' ' || chr(9) || chr(13))) as word, count(*) as n from {_LINES} where trim(value, ' ' || chr(9) || chr(13)) <> '' and not starts_with(trim(value, ' ' || chr(9) || chr(13)), '#') group by all")
def r12_neighbour_lists(spark, d):
    """Lists of one entry a line, in small letters; comments skipped."""
    rows = lists.data_lines(_lines(spark, d)).select((F.col("doc_id") % 4).alias("list"), F.lower("value").alias("word"))
    return rows.groupBy("list", "word").agg(F.count("*").alias("n"))


@query(f"select doc_id, trim(value, ' ' || chr(9) || chr(13)) as sentence from {_LINES} where trim(value, ' ' || chr(9) || chr(13)) <> ''")
def r14_sentence_lines(spark, d):
    return lists.full_lines(_lines(spark, d)).select("doc_id", F.col("value").alias("sentence"))


@query("select n_name as name, n_nationkey % 3 = 0 as installed from nation where n_name in (select n_name from nation where n_nationkey % 2 = 0)")
def r17_installed_lists(spark, d):
    """The catalog's entries for which there is a file."""
    n = t(spark, d, "nation")
    files = n.filter("n_nationkey % 2 = 0").select("n_name")
    return n.join(F.broadcast(files), "n_name", "left_semi").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 == 0).alias("installed"))  # a catalog of some hundred entries


@query(f"select lang, word as line, row_number() over (partition by lang order by word) as pos from (select distinct lang, word from {WORDS}) union all select lang, count(distinct word)::varchar, 0 from {WORDS} group by 1")
def k02_form_files(spark, d):
    """Word forms as written: the count first, then the forms in ordinal order."""
    return lists.form_lines(_counts(spark, d).select("lang", "word"), "lang")


@query("select event_type, '{' || string_agg('\"' || k || '\":' || n, ',' order by k) || '}' as metrics from (select event_type, 'u' || user_id % 5 as k, count(*) as n from events group by all) group by 1")
def k03_baseline_json(spark, d):
    """Metrics as one JSON object, keys in order."""
    m = t(spark, d, "events").groupBy("event_type", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("k")).agg(F.count("*").alias("n"))
    return lists.metric_json(m, ["event_type"], "k", "n", "metrics")


@query("select event_type || ' | ' || lpad(count(*)::varchar, 8, ' ') || ' | ' || round(100 * avg((value > 50)::int), 1)::varchar || '%' as line from events group by event_type")
def k07_report_lines(spark, d):
    """Rows of a report as text: name, count, share."""
    e = t(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("string").alias("n"), F.round(100 * F.avg((F.col("value") > 50).cast("int")), 1).cast("string").alias("share"))
    return e.select(F.concat_ws(" | ", "event_type", F.lpad("n", 8, " "), F.concat("share", F.lit("%"))).alias("line"))


_PACK = "(select distinct regexp_replace(path, '/[^/]*$', '') as folder from (select p_brand || '/' || replace(p_type, ' ', '/') || '/' || p_partkey as path, p_partkey from part) where p_partkey % 9 = 0 union select distinct p_brand from part where p_partkey % 4 = 0)"
_FILE = "(select p_brand || '/' || replace(p_type, ' ', '/') || '/' || p_partkey as path, p_size from part)"


def _files(spark, d):
    p = t(spark, d, "part")
    path = F.concat_ws("/", "p_brand", F.translate("p_type", " ", "/"), F.col("p_partkey").cast("string"))
    files = p.select(path.alias("path"), "p_size", "p_partkey", "p_brand")
    packs = files.filter("p_partkey % 9 = 0").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).union(files.filter("p_partkey % 4 = 0").select("p_brand"))
    return files.select("path", "p_size"), packs.distinct()


@query(f"select f.folder, x.path from {_PACK} f join {_FILE} x on starts_with(x.path, f.folder || '/') where not exists (select 1 from {_PACK} g where g.folder <> f.folder and starts_with(g.folder, f.folder || '/') and starts_with(x.path, g.folder || '/'))")
def j14_pack_files(spark, d):
    """Files under each pack's folder but not under one nested in it."""
    return catalog.pack_files(*_files(spark, d)).select("folder", "path")


@query("select layout from (select distinct case event_type when 'click' then 'uk' when 'view' then 'en' when 'error' then 'el' when 'purchase' then 'xx' end as layout from events) where layout in ('uk', 'en', 'el', 'he') and layout not in ('en')")
def j12_missing_lists(spark, d):
    """Languages of the layouts in use that the catalog has and that aren't installed."""
    kind = F.col("event_type")
    used = t(spark, d, "events").select(F.when(kind == "click", "uk").when(kind == "view", "en").when(kind == "error", "el").when(kind == "purchase", "xx").alias("layout")).filter("layout is not null")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "layout string")
    return catalog.missing(used, names("uk", "en", "el", "he"), names("en"))


_REFS = "(select doc_id, case doc_id % 5 when 0 then 'https://models.example/' || source || '/' || lang || '/tree/main/cpu/' || doc_id when 1 then source || '/' || lang || '?x=1' when 2 then source when 3 then ' ' || source || '//' || lang || '/a/b#c ' else null end as ref from documents)"
_REST = "string_split(regexp_replace(regexp_replace(trim(ref), '^.*models\\.example/', ''), '[?#].*$', ''), '/')"


@query(f"""select doc_id, case when len(p) >= 2 then p[1] || '/' || p[2] end as repo, case when len(p) >= 2 then array_to_string(case when len(p) >= 4 and lower(p[3]) in ('tree', 'blob', 'resolve') then p[5:] else p[3:] end, '/') end as sub_path
from (select doc_id, list_filter({_REST}, lambda x: x <> '') as p from {_REFS})""")
def x35_model_references(spark, d):
    """Repository and folder of references to models, with or without a host."""
    x = F.col("doc_id")
    host = F.concat(F.lit("https://models.example/"), "source", F.lit("/"), "lang", F.lit("/tree/main/cpu/"), x.cast("string"))
    ref = F.when(x % 5 == 0, host).when(x % 5 == 1, F.concat("source", F.lit("/"), "lang", F.lit("?x=1"))).when(x % 5 == 2, F.col("source")).when(x % 5 == 3, F.concat(F.lit(" "), "source", F.lit("//"), "lang", F.lit("/a/b#c ")))
    return _docs(spark, d).select("doc_id", M.reference(ref, "models.example").alias("r")).select("doc_id", "r.repo", "r.sub_path")


_FOLDERS = ["cpu-int4", "cuda-fp16", "gpu/webgpu", "DirectML", "npu-qnn", "gpu-int4"]
_PROVIDER = "case when contains(lower(f), 'webgpu') then 'webgpu' when contains(lower(f), 'dml') or contains(lower(f), 'directml') then 'dml' when contains(lower(f), 'cuda') then 'cuda' when contains(lower(f), 'qnn') then 'qnn' else '' end"
_DEVICES = "map {'cpu': 'Cpu', 'dml': 'Gpu', 'directml': 'Gpu', 'cuda': 'Gpu', 'rocm': 'Gpu', 'webgpu': 'Gpu', 'nvtensorrtrtx': 'Gpu', 'qnn': 'Npu', 'vitisai': 'Npu', 'ryzenai': 'Npu'}"


@query(f"select user_id, f as folder, {_PROVIDER} as provider, case when j = 'rocm' then 'Gpu' when {_PROVIDER} <> '' then {_DEVICES}[{_PROVIDER}] when contains(lower(f), 'gpu') then 'Gpu' else 'Cpu' end as device from (select distinct user_id % 60 as user_id, [{', '.join(repr(f) for f in _FOLDERS)}][user_id % 6 + 1] as f, case when user_id % 4 = 0 then 'rocm' end as j from events)")
def x36_pack_devices(spark, d):
    """Provider and device of a pack from its declared options (JSON), else from its folder's name."""
    u = F.col("user_id")
    folder = F.get(F.array(*map(F.lit, _FOLDERS)), (u % 6).cast("int"))
    options = F.when(u % 4 == 0, '{"model": {"decoder": {"session_options": {"provider_options": [{"CPU": {}}, {"ROCm": {}}]}}}}').otherwise("{}")
    rows = t(spark, d, "events").select((u % 60).alias("user_id"), folder.alias("folder"), options.alias("options")).distinct()
    return rows.select("user_id", "folder", M.provider_of_folder(F.col("folder")).alias("provider"), M.device(F.col("folder"), M.declared_providers(F.col("options"))).alias("device"))


@query(f"select distinct name, case when lower(name) = 'directml' then 'dml' else lower(name) end as provider, coalesce({_DEVICES}[lower(name)], 'Cpu') as device from (select unnest([event_type, 'DirectML', 'QNN', 'webgpu', 'RyzenAI']) as name from events)")
def x37_provider_devices(spark, d):
    names = F.array("event_type", *map(F.lit, ["DirectML", "QNN", "webgpu", "RyzenAI"]))
    return t(spark, d, "events").select(F.explode(names).alias("name")).distinct().select("name", M.provider(F.col("name")).alias("provider"), M.device_of(F.col("name")).alias("device"))


@query("select c_custkey, case c_mktsegment when 'BUILDING' then 'cpu' else 'gpu' end as device, list_filter(list_distinct(list_concat(case when c_mktsegment in ('BUILDING', 'MACHINERY') then [] else ['cuda', 'dml'] end, case when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then [] else ['qnn'] end, ['cpu'])), lambda x: x is not null)::varchar as plan from customer".replace("case c_mktsegment when 'BUILDING' then 'cpu' else 'gpu' end", "case c_mktsegment when 'BUILDING' then 'cpu' when 'AUTOMOBILE' then 'gpu' when 'MACHINERY' then 'npu' else 'auto' end").replace("::varchar as plan", " as plan").replace("list_filter(", "array_to_string(list_filter(", 1).replace(" as plan", ", ' ') as plan").replace("list_distinct(", "(", 1))
def b24_execution_plans(spark, d):
    """Providers to try, by preference: those of the devices wished for in order, the processor last."""
    wish = F.when(F.col("c_mktsegment") == "BUILDING", "cpu").when(F.col("c_mktsegment") == "AUTOMOBILE", "gpu").when(F.col("c_mktsegment") == "MACHINERY", "npu").otherwise("auto")
    return t(spark, d, "customer").select("c_custkey", wish.alias("device"), F.array_join(M.execution_plan(wish, ["cuda", "dml"], ["qnn"]), " ").alias("plan"))


@query("select distinct code, case when code in ('ru', 'uk') then 'Cyrillic' when code = 'el' then 'Greek' when code = 'ja' then null else 'Latin' end as script from (select unnest([lang, 'uk-UA', 'EL', 'ja', 'ru_RU']) as tag, string_split(string_split(lower(tag), '-')[1], '_')[1] as code from documents)")
def s18_dictation_scripts(spark, d):
    """Scripts of dictation languages; those that nothing can be done for have none."""
    tags = F.array("lang", *map(F.lit, ["uk-UA", "EL", "ja", "ru_RU"]))
    return _docs(spark, d).select(F.explode(tags).alias("tag")).select(M.language_code(F.col("tag")).alias("code")).distinct().select("code", M.dictation_script(F.col("code")).alias("script"))


@query("select lang, model, case when model = 'small-model' then lang in ('en', 'ru', 'uk', 'he', 'ar') else true end as may from (select distinct lang, unnest(['small-model', 'other']) as model from documents)")
def s19_spelling_languages(spark, d):
    """Whether a model may choose among spellings in a language: measured ones only, unless it was not measured."""
    rows = _docs(spark, d).select("lang").distinct().select("lang", F.explode(F.array(F.lit("small-model"), F.lit("other"))).alias("model"))
    return rows.select("lang", "model", M.may_spell(F.col("model"), F.col("lang"), {"small-model": ["en", "ru", "uk", "he", "ar"]}).alias("may"))


@query("select event_id, case when p is null or p in ('click', 'view', 'signup') then true else false end as kept from (select event_id, case when event_id % 9 = 0 then null else event_type end as p from events)")
def f16_text_models(spark, d):
    """Catalog entries for text: without a tag, or with one of three."""
    tag = F.when(F.col("event_id") % 9 != 0, F.col("event_type"))
    return t(spark, d, "events").select("event_id", (tag.isNull() | tag.isin("click", "view", "signup")).alias("kept"))


@query("select c_name, row_number() over (order by c_mktsegment = 'BUILDING' desc, c_acctbal desc, c_name) as pos from (select *, row_number() over (partition by c_name order by c_custkey) as i from customer) where i = 1 qualify pos <= 50")
def o04_catalog_order(spark, d):
    """The first fifty of a catalog: recommended ones first, then the most downloaded, then by name."""
    c = t(spark, d, "customer").groupBy("c_name").agg(F.min_by(F.struct("c_mktsegment", "c_acctbal"), "c_custkey").alias("r")).select("c_name", "r.*")
    top = c.orderBy((F.col("c_mktsegment") == "BUILDING").desc(), F.desc("c_acctbal"), "c_name").limit(50)
    order = Window.orderBy((F.col("c_mktsegment") == "BUILDING").desc(), F.desc("c_acctbal"), "c_name")  # of fifty rows
    return top.select("c_name", F.row_number().over(order).cast("long").alias("pos"))


@query("select id, downloads from (select unnest(range(0, 40)) as page), (select n_name || page as id, n_nationkey * 10 as downloads, n_regionkey from nation) where n_regionkey <> 0 and page < 3".replace("(select unnest(range(0, 40)) as page), (select", "(select unnest(range(0, 3)) as page) p, lateral (select").replace(" and page < 3", ""))
def r16_catalog_pages(spark, d):
    """Entries of paged JSON replies, each once, but those of kinds left out."""
    n = t(spark, d, "nation")
    entry = F.struct(F.concat("n_name", F.col("page").cast("string")).alias("id"), (F.col("n_nationkey") * 10).alias("downloads"), F.col("n_regionkey").cast("string").alias("pipeline_tag"))
    pages = n.select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("page")).groupBy("page", "n_regionkey").agg(F.to_json(F.collect_list(entry)).alias("value"))
    return catalog.entries(pages.union(pages).select("value"), ["0"]).select("id", "downloads")


@query("select distinct word as form, row_number() over (order by word) as pos from (select distinct p_name as word from part)")
def o05_sorted_forms(spark, d):
    """Forms in ordinal order with their places, found range by range."""
    return catalog.numbered(t(spark, d, "part").select(F.col("p_name").alias("form")).distinct(), "form", "pos")


@query("select phrase, row_number() over (order by length(phrase) desc, phrase) as pos from (select distinct p_type as phrase from part)")
def o06_longest_first(spark, d):
    """Rules in the order in which they are tried: the longest phrase first. As many as there are rules."""
    rules = t(spark, d, "part").select(F.col("p_type").alias("phrase")).distinct()
    return rules.select("phrase", F.row_number().over(Window.orderBy(F.desc(F.length("phrase")), "phrase")).cast("long").alias("pos"))
