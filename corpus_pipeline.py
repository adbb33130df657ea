"""A training-data pipeline over ``documents``: five stages, each on all its predecessor kept.

Stages in order: toxic documents go, one document of each near-duplicate group
stays, documents that hold benchmark passages go, personal data is masked, and
what is left is encoded with SentencePiece. Each stage takes (spark, docs,
sf_dir); its result is written as Parquet to the shared folder and read again as
the next one's docs. All but the last keep the columns of ``documents``.

Every stage judges rows by their own text. Rows with a null id stay where a stage
does not reject their text; rows that repeat id and text fold into one in
near-duplicate removal, different texts of one id are different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsfold.llm import decontaminate, near_dup, pii, spm, toxicity
from tsfold.llm.common import table
from tsfold.llm.queries import TOXIC, _vocabulary
from tsfold.session import scratch_path


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents of ``docs`` and drop the rows scored as toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), TOXIC)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of linked documents."""
    return near_dup.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words in a row (or all words) of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind and renew the lengths."""
    return pii.mask(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, n_tokens, ids."""
    return spm.encode(docs, _vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("pii", mask_pii),
    ("sentencepiece", encode),
]

#: Bytes of a row group of the stages' results: bounds what a writing task holds.
BLOCK_BYTES = 16 << 20

#: The fitted classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
