"""Training-data pipeline: from documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last keep the
columns of documents.

Defined cases: null and empty texts and texts without letters go in the first
stage; rows without a doc_id are kept where a stage names documents; repeated
rows stay together until the mix, which takes each for itself; empty tables pass
through all stages; other columns of the input are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyweft.llm import language_id, line_dedup, mixing, ngram_join, slack_packing
from skyweft.llm.common import land
from skyweft.llm.queries import tokenizer_path

#: Documents whose best language is less sure than this are rejected.
LEAST_SCORE = 0.5


def _matching(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among the decided ones, null being one of them."""
    ids = decided.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_id"]), "left_semi")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is sure of."""
    judged = language_id.identify(docs, language_id.fit(docs))
    return _matching(docs, judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group with a Jaccard similarity of 0.8 or more on 5-word shingles."""
    return ngram_join.first_of_components(docs, words=5, percent=80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has."""
    return line_dedup.dedup_lines(docs, carry=tuple(docs.columns), report=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of at most 2048 tokens."""
    return slack_packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", keep_languages),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", remove_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Stages use trained models, components and random draws, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = land(docs)
    return docs
