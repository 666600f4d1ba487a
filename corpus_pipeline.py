"""A training corpus from raw documents, in five stages.

1. quality: documents that the classifier rejects go. 2. toxicity: documents that the tagger rejects go. 3. near
duplicates: one document of each SimHash group stays. 4. mixing: sources are repeated or thinned to their targets.
5. packing: ids of all that is left, cut into sequences.

Models learn from the labelled documents among those that reach their stage. All stages but the last return the
columns of the documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, packing, quality, simhash, toxicity
from millrace.llm.common import shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more. Null and empty texts score like any other; without labels all score 0.5 and stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3. Null and empty texts score 0 and stay; without toxic labels all stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id, then text hash. Texts without words, null ones too, are one group."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks. A null source is a source; without any words nothing is taken."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the pieces of all sequences. A null text is empty: its id 1 alone is packed. An empty table gives none."""
    return packing.piece_digests(packing.pack_documents(docs))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Stages 1, 2 and 5 rest on models and a tokenizer, which SQL can't express; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
