"""From raw documents to token ids: STAGES in order, each over all rows that the one before kept.

All stages but the last return the columns of their documents, further ones and clashing names included;
an empty table gives an empty table. Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallgrid.llm import exact_dedup, langid, minhash, mixing, queries
from recallgrid.llm.storage import ROWS_A_BATCH, arrow_rows, new_path, remove, scratch

#: No stage's rows can be expressed in SQL as a whole (language models, sketches, tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, lang set to it. Null, empty and letterless texts go; a null lang, source or doc_id is no hindrance; repeated rows are judged alike."""
    return langid.identify_documents(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal but for A-Z: the row with the largest doc_id (a null one is the smallest); of rows alike in doc_id and text one."""
    return exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates (five-word shingles, similarity 0.8 or more): the smallest doc_id. Texts without words and rows without doc_id stay."""
    return minhash.drop_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 0 to 2 times. A null source is a source of its own; texts without words are taken 0 times; rows alike in doc_id, source and text count as one."""
    return mixing.mixed(docs, queries.MIX_WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of ids and of the decoded text of each row; a null text counts as empty."""
    return queries.bpe_digests(docs, queries.tokenizer("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup_stage), ("MinHash near-dedup", near_dedup), ("mixing", mix_sources), ("BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is written as Parquet and read again.

    A stage's working tables, and the rows of the stage before it, are removed once its rows are written.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"pipeline-{k}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            with arrow_rows(spark, ROWS_A_BATCH):
                out.write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return docs
