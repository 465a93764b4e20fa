"""Names of models, providers, devices and dictation languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingsmith.functions._let import let

# Devices of execution providers, scripts of dictation languages, languages without a script here.
DEVICES = {
    "cpu": "Cpu", "dml": "Gpu", "directml": "Gpu", "cuda": "Gpu", "rocm": "Gpu", "webgpu": "Gpu", "nvtensorrtrtx": "Gpu",
    "qnn": "Npu", "vitisai": "Npu", "ryzenai": "Npu",
}
DICTATION = {
    "Cyrillic": "ru uk be bg mk sr kk tg tt ba mn", "Greek": "el", "Hebrew": "he yi", "Arabic": "ar fa ur ps sd", "Georgian": "ka", "Armenian": "hy",
    "": "am as bn bo gu hi ja km kn ko lo ml mr my ne pa sa si ta te th yue zh",
}
SURE, RETRY_BELOW, RETRY_SECONDS = 0.7, 0.75, 1.5


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def reference(ref: Column, host: str) -> Column:
    """(repo, sub_path) of "owner/name[/tree/branch]/path", after a host and before ? or #; null without two parts."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(ref), f"(?i)^.*{host.replace('.', '[.]')}/", ""), "[?#].*$", "")

    def parts(p: Column) -> Column:
        branch = (F.size(p) >= 4) & F.lower(F.get(p, F.lit(2))).isin("tree", "blob", "resolve")
        rest = F.when(branch, F.slice(p, F.lit(5), F.size(p))).otherwise(F.slice(p, F.lit(3), F.size(p)))
        found = F.struct(F.concat_ws("/", F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("repo"), F.array_join(rest, "/").alias("sub_path"))
        return F.when(F.size(p) >= 2, found)

    return let(F.filter(F.transform(F.split(bare, "/"), lambda x: F.trim(x)), lambda x: x != ""), parts)


def provider(name: Column) -> Column:
    return F.when(F.lower(name) == "directml", "dml").otherwise(F.lower(name))


def device_of(name: Column) -> Column:
    return F.coalesce(_looked_up(F.lower(name), DEVICES), F.lit("Cpu"))


def provider_of_folder(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("webgpu"), "webgpu").when(low.contains("dml") | low.contains("directml"), "dml").when(low.contains("cuda"), "cuda").when(low.contains("qnn"), "qnn").otherwise("")


def declared_providers(config: Column) -> Column:
    """Names of providers in a pack's JSON, in order; none where it is no such JSON."""
    options = F.from_json(F.get_json_object(config, "$.model.decoder.session_options.provider_options"), "array<map<string, string>>")
    return F.coalesce(F.transform(F.flatten(F.transform(options, F.map_keys)), provider), F.array().cast("array<string>"))


def device(folder: Column, declared: Column) -> Column:
    """Of the first declared provider that isn't the processor, else of the folder's name."""
    other = F.get(F.filter(F.transform(declared, device_of), lambda x: x != "Cpu"), F.lit(0))
    named = provider_of_folder(folder)
    return F.when(other.isNotNull(), other).when(named != "", device_of(named)).when(F.lower(folder).contains("gpu"), "Gpu").otherwise("Cpu")


def execution_plan(preference: Column, graphics: list[str], neural: list[str]) -> Column:
    """Providers to try for a preference (cpu, gpu, npu, else any), each once, the processor last."""
    on = lambda kind, names: F.when(preference.isin("cpu", kind), F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, names)))
    return F.array_distinct(F.concat(on("npu", graphics), on("gpu", neural), F.array(F.lit("cpu"))))


def language_code(tag: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(tag)), "^([^-_]*)", 1)


def dictation_script(code: Column) -> Column:
    """Latin where nothing else is known; null for languages without a script here."""
    table = {c: s for s, codes in DICTATION.items() for c in codes.split()}
    return let(F.coalesce(_looked_up(code, table), F.lit("Latin")), lambda s: F.when(s != "", s))


def may_spell(model: Column, lang: Column, measured: dict[str, list[str]]) -> Column:
    out = F.lit(True)
    for name, langs in measured.items():
        out = F.when(F.lower(model) == name, F.lower(lang).isin(langs)).otherwise(out)
    return out


def dictated_language(main: Column, detected: Column, probability: Column) -> Column:
    """The detected language if it is the main one or sure enough."""
    found = language_code(detected)
    return F.when(detected.isNull(), language_code(main)).when((found == language_code(main)) | (probability >= SURE), found).otherwise(language_code(main))


def retried(first: Column, second: Column, probability: Column, second_probability: Column, seconds: Column) -> Column:
    """A second language's text if the first was unsure, there was speech enough, and the second is better."""
    again = (probability < RETRY_BELOW) & (seconds >= RETRY_SECONDS)
    return F.when(again & (second_probability > probability), second).otherwise(first)
