"""From raw documents to packed training sequences: quality, exact copies, near copies, source mix, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import quality
from concord.llm.common import stash, table
from concord.llm.exactdedup import drop_exact_copies
from concord.llm.mixing import mix_documents
from concord.llm.neardup import drop_near_copies
from concord.llm.packing import pack_sequences


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above. Null and empty texts are scored too; a null id is scored and never learnt from; repeated rows go each by itself; no rows give none; more columns stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id. Null texts equal empty ones; a row with a null id stays only if no other has its text; rows that share an id go together; no rows give none; more columns stay."""
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id. Texts without words and rows with a null id stay; rows that share an id go together; no rows give none; more columns stay."""
    return drop_near_copies(docs, width=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks. A null source is a source; null texts have size 0; rows that share an id draw alike; no rows give none; more columns stay."""
    return mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences and their ids. A null text is the end id alone; a null id stays null; repeated rows are packed each; no rows give none; other columns are left out."""
    pieces = pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_exact_copies),
    ("near dedup", without_near_copies),
    ("source mix", mixed_sources),
    ("packing", packed_sequences),
]

#: No SQL can express the classifier, the sketches and the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each stage's result stored in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
