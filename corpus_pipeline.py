"""The corpus pipeline: stages over `documents`, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planforge.llm.bpe import encode_documents
from planforge.llm.common import saved, table
from planforge.llm.decontaminate import drop_leaked
from planforge.llm.langid import keep_labelled
from planforge.llm.minhash import keep_first
from planforge.llm.substrings import drop_passages

#: (name, function) in order. A function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language", keep_labelled),
    ("near_duplicates", keep_first),
    ("passages", drop_passages),
    ("benchmark", drop_leaked),
    ("tokens", encode_documents),
]

#: No stage can be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the stages keep: doc_id, text (as left), lang, source, n_tokens, ids_le (packed 32-bit ids) and round_trip (whether they decode to the text)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
