"""From raw documents to token ids in five stages.

Null and empty texts are judged by the classifier like any other, pass line
dedup as they are, count as copies of each other, have no tokens to mix and
become the begin and end ids; a null id is kept. Other columns of the documents
pass through to the last stage. An empty table gives no rows.

Documents that the quality classifier rejects go; repeated three-line windows
are removed; of each group of texts whose five-word shingles are alike by 0.8 or
more (met by SimHash, settled by the shingles themselves) one row stays, that of
the smallest id; sources are mixed to temperature weights, which takes documents of small
sources up to twice; what is left is encoded. Each stage's result is written as
Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapewright.llm import line_dedup, mixture, near_copies, piece_codec, quality_net
from shapewright.llm.common import forget, reach_workers, settle, settled_paths, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    scored = quality_net.quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(docs)
    changed = F.when(F.col("n_removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return near_copies.one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return piece_codec.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    given: list[str] = []
    for _, stage in STAGES:
        before = set(settled_paths())
        docs = settle(stage(spark, docs, sf_dir))
        made = [p for p in settled_paths() if p not in before]
        forget(spark, [*made[:-1], *given])  # what the stage wrote on its way, and what it read
        given = made[-1:]
    return docs
