"""Catalogs of lists and models: pages of entries, packs of files, what is missing, places in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pack_files(files: DataFrame, packs: DataFrame) -> DataFrame:
    """files (path, …) with the folder of the innermost pack that holds them; an equi-join on each folder of a path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    under = files.select("*", F.explode(above).alias("folder")).join(packs, "folder", "left_semi")
    inner = Window.partitionBy("path").orderBy(F.desc(F.length("folder")))
    return under.withColumn("_r", F.row_number().over(inner)).filter("_r = 1").drop("_r")


def missing(used: DataFrame, catalog: DataFrame, installed: DataFrame) -> DataFrame:
    """What is in use and in the catalog but not installed; the lists of names are a catalog's, some hundred at most."""
    key = used.columns[0]
    return used.distinct().join(F.broadcast(catalog), key, "left_semi").join(F.broadcast(installed), key, "left_anti")


def entries(pages: DataFrame, left_out: list[str]) -> DataFrame:
    """(id, downloads, pipeline_tag) of JSON pages (value), each id once; entries with a tag of left_out go."""
    found = pages.select(F.explode(F.from_json("value", "array<struct<id: string, downloads: bigint, pipeline_tag: string>>")).alias("e")).select("e.*")
    return found.filter(F.col("pipeline_tag").isNull() | ~F.col("pipeline_tag").isin(left_out)).dropDuplicates(["id"])


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their places (from 1) in the order of a column of distinct values.

    Range partitions are numbered on their own and set off by the sizes of those before them, so no task sorts all rows.
    """
    ranged = rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return ranged.withColumn("_i", own).join(F.broadcast(before), "_p").select(*rows.columns, (F.col("_before") + F.col("_i")).alias(name))
