"""Text sources: frequency lists and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) of lines "word count": at least two fields, the second a count above 0."""
    return parsed(spark.read.text(path))


def parsed(lines: DataFrame) -> DataFrame:
    f = F.split("value", "[ \t]+")
    return lines.filter(F.size(f) >= 2).select(f[0].alias("word"), F.expr("try_cast(split(value, '[ \t]+')[1] as bigint)").alias("n")).filter("n > 0")


def word_forms(spark: SparkSession, path: str) -> DataFrame:
    """Distinct forms of JSON lines {word, forms: [{form, tags}]}, but those with tags that name no spelling."""
    # Tags of forms that are no spelling.
    out = ["romanization", "class", "table-tags", "inflection-template"]
    rows = spark.read.text(path).select(F.from_json("value", "word string, forms array<struct<form: string, tags: array<string>>>").alias("j")).select("j.*")
    kept = rows.select(F.explode("forms").alias("f")).filter(~F.coalesce(F.arrays_overlap("f.tags", F.array(*map(F.lit, out))), F.lit(False))).select(F.col("f.form").alias("form"))
    return rows.select(F.col("word").alias("form")).union(kept).filter("form is not null").distinct()


def parsed_last(lines: DataFrame) -> DataFrame:
    """(word, n): the first field in small letters, the last as a count (null if it is none)."""
    f = F.split("value", "[ \t]+")
    return lines.filter(F.size(f) >= 2).select(F.lower(f[0]).alias("word"), F.element_at(f, -1).try_cast("bigint").alias("n"))


def digits_last(lines: DataFrame) -> DataFrame:
    """Lines whose last field is digits only."""
    return lines.filter(F.col("value").rlike("(^|[ \t])[0-9]+$"))


def tab_column(lines: DataFrame, at: int) -> DataFrame:
    """(field): a column (from 0) of lines of two tab-separated fields or more."""
    f = F.split("value", "\t", -1)
    return lines.filter(F.size(f) >= 2).select(F.get(f, F.lit(at)).alias("field"))


def data_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines that are neither empty nor comments."""
    return lines.withColumn("value", F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", "")).filter("value <> '' and not startswith(value, '#')")


def metrics(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(…by, metric, value): entries of a JSON object of numbers; nulls and other values are left out."""
    found = rows.select(*by, F.explode(F.from_json(column, "map<string, string>")).alias("metric", "value"))
    return found.withColumn("value", F.col("value").try_cast("double")).filter("value is not null")


def as_line(word: str, n: str):
    return F.concat_ws(" ", word, F.col(n).cast("string"))


def write_forms(words: DataFrame, path: str) -> None:
    """Distinct forms in ordinal order as text files; the count is written beside them (path + '.count')."""
    forms = words.select("word").distinct()
    forms.sort("word").select(F.col("word").alias("value")).write.mode("overwrite").text(path)
    forms.agg(F.count("*").cast("string").alias("value")).write.mode("overwrite").text(path + ".count")


def any_counts(lines: DataFrame, by: list[str], name: str) -> DataFrame:
    """(…by, name): whether any line parses as a word with a count above 0."""
    n = F.expr("try_cast(get(split(value, '[ \t]+'), 1) as bigint)")
    return lines.groupBy(*by).agg(F.bool_or(F.coalesce(n > 0, F.lit(False))).alias(name))


def lexicon_forms(lines: DataFrame, by: list[str]) -> DataFrame:
    """(…by, form) of expanded lexicons: lines of digits only are counts, flags stand after a slash."""
    return lines.filter(~F.col("value").rlike("^[0-9]+$")).select(*by, F.regexp_extract("value", "^([^/\t]*)", 1).alias("form")).filter("form <> ''")


def lexicon(spark: SparkSession, path: str) -> DataFrame | None:
    """(form) of a lexicon's path.dic, or None where it or its path.aff is missing."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for end in (".dic", ".aff"):
        file = fs_path(path + end)
        if not file.getFileSystem(conf).exists(file):
            return None
    return lexicon_forms(spark.read.text(path + ".dic"), [])


def forms_of_json(lines: DataFrame) -> DataFrame:
    """word_forms, for lines (value)."""
    # Tags of forms that are no spelling.
    out = ["romanization", "class", "table-tags", "inflection-template"]
    rows = lines.select(F.from_json("value", "word string, forms array<struct<form: string, tags: array<string>>>").alias("j")).select("j.*")
    kept = rows.select(F.explode("forms").alias("f")).filter(~F.coalesce(F.arrays_overlap("f.tags", F.array(*map(F.lit, out))), F.lit(False))).select(F.col("f.form").alias("form"))
    return rows.select(F.col("word").alias("form")).union(kept).filter("form is not null").distinct()


def cases(lines: DataFrame) -> DataFrame:
    """(typed, expected, status, note) of tab-separated lines; empty ones and comments are skipped."""
    f = F.split("value", "\t", -1)
    return lines.filter("value <> '' and not startswith(value, '#')").select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(["typed", "expected", "status", "note"])])


def extras(lines: DataFrame) -> DataFrame:
    """(code, words): extra words of each language in order; a line of fewer than two fields is an error."""
    f = F.split("value", "\t", -1)
    code = F.when(F.size(f) >= 2, F.get(f, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), "value")))
    rows = lines.filter("value <> '' and not startswith(value, '#')").select(code.alias("code"), F.get(f, F.lit(1)).alias("word"))
    return rows.groupBy("code").agg(F.sort_array(F.collect_list("word")).alias("words"))


def full_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines that aren't empty."""
    return lines.withColumn("value", F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", "")).filter("value <> ''")


def form_lines(words: DataFrame, by: str) -> DataFrame:
    """(by, line, pos): a count line first, then the distinct forms of each list in ordinal order."""
    from pyspark.sql import Window

    forms = words.distinct()
    body = forms.select(by, F.col("word").alias("line"), F.row_number().over(Window.partitionBy(by).orderBy("word")).cast("long").alias("pos"))
    return body.union(forms.groupBy(by).agg(F.count("*").cast("string").alias("line")).select(by, "line", F.lit(0).cast("long").alias("pos")))


def metric_json(rows: DataFrame, by: list[str], key: str, value: str, name: str) -> DataFrame:
    """(…by, name): a JSON object of metrics, keys in order."""
    pairs = F.sort_array(F.collect_list(F.struct(key, value)))
    return rows.groupBy(*by).agg(F.to_json(F.map_from_entries(pairs)).alias(name))


def replace_atomically(df: DataFrame, path: str, version: str) -> None:
    """Writes df beside its place and moves it there in one step; a file .version tells what it is.

    Readers see the old table or the new one, never a part. The old one is kept as path.old until the new one stands.
    """
    spark = df.sparkSession
    staging, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(staging)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(at(f"{staging}/.version"), True)
    out.writeBytes(version)
    out.close()
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(at(staging), at(path)):
        raise OSError(f"{staging} can't be moved")
    fs.delete(at(old), True)
