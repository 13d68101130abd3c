"""From documents to packed training sequences: five stages, each of them an operator of pliego.llm.

A stage takes the documents that the one before it kept and returns documents; the last returns pieces with their token ids and their
places in sequences. What a stage returns is written as Parquet and read again as the next one's documents.

Defined results, for all stages: columns besides those of documents are dropped; a null or empty text is kept by the first stage if no features score
below 0.5, is like all other texts without words to the second, loses nothing in the third, is never taken by the mix, and would make a piece of the
end id alone; rows without an id, or that share one, are each judged, and where one row of a group stays, it is the first by id, then by text, with ids
before none; repeated rows are one group; an empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.llm import mixing, packing, simhash, suffixes, toxicity
from pliego.llm._common import materialize, read_table
from pliego.llm.registry import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text isn't scored as toxic."""
    return toxicity.without_toxic(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those that links of a Jaccard similarity of 0.8 join, by shingles of five words.

    Fingerprints only find the candidates; each link is verified by the shingles. README has the recall by similarity.
    """
    return simhash.one_of_each_similar(docs.select(*COLUMNS), shingle=5, least=0.8)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that earlier documents hold; n_chars follows the text."""
    out = suffixes.remove_repeats(docs.select(*COLUMNS), length=50, with_text=True, carry=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, once or twice."""
    return mixing.mixed_texts(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence, offset and ids (little-endian unsigned 32-bit integers): what training reads."""
    return packing.pack(docs.select(*COLUMNS), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Neither the model's scores nor fingerprints nor tokens are SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = materialize(docs, "stage")
    return docs
