"""A corpus pipeline: each stage works on all that the one before kept, as written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforge.llm.common import Tables
from sparkforge.llm.op01_mixing import mix
from sparkforge.llm.op06_quality_rules import quality_rules
from sparkforge.llm.op07_token_planes import token_planes
from sparkforge.llm.op08_decontamination import decontaminate
from sparkforge.llm.op10_minhash_dedup import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words that a worker process remembers in the token stage: its executor has all the memory of the stages before.
REMEMBERED = 200_000


def without(docs: DataFrame, ids: DataFrame, tables: Tables) -> DataFrame:
    """Rows of docs whose doc_id is none of ids. The ids are written first, so Spark knows their size when it plans the join."""
    gone = tables.write(ids.toDF("gone").where("gone is not null").distinct(), "gone")
    return docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those without a text go."""
    return quality_rules(docs.select(*COLUMNS), carry=COLUMNS).where("kept").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest id.

    Rows that repeat a doc_id are one document. Rows without an id stay.
    """
    docs = docs.select(*COLUMNS)
    verdict = near_duplicates(docs, n=5, percent=80)
    left = without(docs, verdict.where("not kept").select("doc_id"), Tables(spark, "pipeline"))
    named = left.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(left.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select("doc_id"), Tables(spark, "pipeline"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights 1, 2, 3, repeating: a document stands as often as it is drawn, or not at all."""
    return mix(docs.select(*COLUMNS)).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32 of each document in them."""
    return token_planes(docs.select(*COLUMNS), words=REMEMBERED)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_planes", token_stage),
]
#: Near duplicates by texts, permuted blocks and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
