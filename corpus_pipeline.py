"""A training corpus from the documents table: toxic documents go, of exact and near copies one stays,
sources are mixed to their weights, and what is left is packed into sequences.

Each stage is written as a table in the cluster's shared folder and read again as the next one's input,
so a lost executor costs no more than the tasks it ran."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from kgweave.llm.common import documents, held_out, labels, materialise
from kgweave.llm.tokens import public_path

CAPACITY, TOXIC_FROM = 2048, 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM, by a model of the labelled rows outside the held-out fold.

    Null and empty texts score low and stay; repeated rows stay or go together; null ids don't matter. Empty
    tables give none."""
    known = labels(spark, sf_dir).where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))
    return toxicity.without_toxic(docs, toxicity.train(docs, known), TOXIC_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The one row of each group of equal normalised texts that stays: the longest, then the smallest id.

    Null texts count as empty and are one group; null ids come last; of repeated rows one stays. An empty
    table gives none."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones.

    Documents without words are linked with nothing and stay. Of rows with one id and different texts each is judged
    by its own text's group; rows that repeat id and text stay or go together (the stage before leaves none). Null
    ids come after all others. An empty table gives none."""
    return ngram_join.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null texts have no words and weigh nothing; a null source is one of its own; null and repeated ids draw by
    their texts. An empty table gives none."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences.

    Null and empty texts are one piece of the end id alone; repeated rows are placed each; columns besides doc_id
    and text don't matter. An empty table gives none."""
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The first and third stages need a trained model and components; see tests/llm for brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
