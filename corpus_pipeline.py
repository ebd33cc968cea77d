"""A corpus pipeline made of five operators; each stage reads what the one before has written.

Null texts and texts without words do not pass the quality rules. Null doc_ids, repeated doc_ids and repeated rows: each
row is judged by itself; of equal rows, as of all near-duplicates, one stays. Extra columns of documents pass through all
stages but the last, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import free, kept, temporary
from sensorloom.llm.decontaminate import contamination
from sensorloom.llm.packing import pack_documents
from sensorloom.llm.quality import quality_rules
from sensorloom.llm.secret_scan import secret_scan
from sensorloom.llm.simhash import near_dedup


def with_text(docs: DataFrame, rows: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` with another text, and its length where there is a column for it."""
    changed = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return rows.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines above the limits."""
    q = free(docs, "quality")
    rows = quality_rules(docs, out=q)
    return with_text(docs, rows.filter(F.col(q)["kept"]), F.col(q)["clean_text"])


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    leak = free(docs, "leak")
    rows = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=leak)
    return rows.filter(~F.col(leak)["contaminated"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a marker; all documents stay."""
    found = free(docs, "secrets")
    return with_text(docs, secret_scan(docs, out=found), F.col(found)["redacted"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]
#: Packing needs a tokenizer, which SQL has not; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What stages write for themselves, and what they read, is deleted when it is used up."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark):
        for name, stage in STAGES[:-1]:
            with temporary(spark):
                docs = kept(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        name, stage = STAGES[-1]
        return kept(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
