"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingsmith.llm._spark import table


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lingsmith.llm.quality import score

    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lingsmith.llm.nndescent import links

    return links(spark, table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lingsmith.llm.packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lingsmith.llm.jaccard import groups

    return groups(spark, table(spark, sf_dir, "documents"))


def op5_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lingsmith.llm.suffixes import dedup

    return dedup(spark, table(spark, sf_dir, "documents"))


def op6_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lingsmith.llm.toxicity import score

    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left."""
    from lingsmith.llm.linededup import dedup_lines

    return dedup_lines(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as often as it is taken: every one once at least, no source passed over more than twice."""
    from lingsmith.llm.mixing import mix

    return mix(spark, table(spark, sf_dir, "documents"), repetition=2.0).select("doc_id", "source", "epoch", "place")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lingsmith.llm.fingerprint import probe

    return probe(spark, table(spark, sf_dir, "documents"))


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lingsmith.llm.wavelet import read_shards, write_shards

    return read_shards(write_shards(spark, table(spark, sf_dir, "documents"), _path("word_bpe_49k.json")))


QUERIES = {f.__name__: f for f in (op1_quality_mil, op2_embedding_nn_descent, op3_best_fit_packing, op4_ngram_jaccard_join, op5_bwt_dedup, op6_toxicity_ftrl, op7_line_dedup, op8_source_mixing, op9_fingerprints, op10_wavelet_tokens)}

ORACLES: dict[str, str] = {}
