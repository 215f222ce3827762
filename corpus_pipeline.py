"""A training corpus from raw documents: quality, near copies, shared passages, benchmark leaks, packing.

Each stage takes what the stage before kept, written as Parquet and read again, and returns the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm.decontam import without_contamination
from skyledger.llm.lzfactor import remove_shared_passages
from skyledger.llm.minhash import near_duplicates
from skyledger.llm.packing import pack
from skyledger.llm.quality import judge
from skyledger.operators.lineage import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the robust distance reject go. Rows with one id go together; rows without an id stay."""
    return docs.join(judge(docs).filter("NOT kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays, with all its rows; rows without an id stay."""
    return docs.join(near_duplicates(docs).filter("NOT kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has are cut out; ``n_chars`` follows the text."""
    # Under names that no result of the operator has.
    names = {c: f"pipeline_column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    cut = remove_shared_passages(docs.withColumnsRenamed(names), untouched=True)
    new = {c: F.col(names.get(c, c)) for c in docs.columns} | {"text": F.col("kept")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(new["n_chars"])
    return cut.select(*[new[c].alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("shared passages", shared_passages),
    ("benchmark leaks", benchmark_leaks),
    ("packing", packed_sequences),
]

#: The first stage iterates over estimates and the last tokenizes: SQL has neither. tests/llm checks against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; every stage but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
