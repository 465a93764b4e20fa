"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written before the next reads
it. All but the last return the columns of documents.

Defined cases: null and empty texts are scored like others and pass the line and Jaccard stages as they are; a very long
text is worked on whole; repeated rows are one document to the line and Jaccard stages, and one of them stays; rows of one
id with different texts both stay, rows without an id all do; ties go to the smallest id; a table without rows gives none;
other columns are kept, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingsmith.llm import jaccard, linededup, mixing, packing, quality
from lingsmith.llm._spark import staged, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the quality classifier takes for junk (score under 0.5)."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"), least=0.5)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes common blocks of lines from later documents; a document of which nothing is left goes."""
    found = linededup.dedup_lines(spark, docs).filter("n_removed = 0 or text <> ''").select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words, similarity 0.8."""
    return jaccard.one_of_each(spark, docs, percent=80, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document once at least, those of small sources up to twice."""
    return mixing.mix(spark, docs, repetition=2.0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 2,048 tokens."""
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("line dedup", cut_lines),
    ("n-gram Jaccard join", one_of_each),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: Classifier, alignment and packing are beyond SQL; tests/llm/test_pipeline.py compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
