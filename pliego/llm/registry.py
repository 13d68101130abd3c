"""The registered queries of the subpackage, one for each operator, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_table

    return token_table(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op2_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(read_table(spark, sf_dir, "documents")).drop("source")


def op4_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), length=50)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).drop("source")


def op7_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(read_table(spark, sf_dir, "pages")).drop("url")


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .simhash import near_duplicates

    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import score

    return score(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import digests, periodic_runs, repeat_tail

    return digests(periodic_runs(read_table(spark, sf_dir, "documents"), words_of=repeat_tail))


def op12_striped_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .alignment import align

    out = align(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return out.withColumn("groups_sha256", F.coalesce("groups_sha256", F.lit("")))


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import labels

    return labels(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_spherical_caps, op3_line_frequency, op4_prefix_free_parsing, op5_best_fit_packing, op6_mix_sources, op7_noisy_channel_toxicity, op8_warc, op9_simhash_trie, op10_context_tree_weighting, op11_periodic_runs, op12_striped_alignment, op13_license_diagonals)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {"op2_spherical_caps": oracles.OP2, "op3_line_frequency": oracles.OP3, "op8_warc": oracles.OP8}
