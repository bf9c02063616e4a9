"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeweave.llm import decontam, mixing, quality, secrets, simhash
from latticeweave.llm._common import table, work_dir, written

#: KN perplexity, SimHash components and hash offsets are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.judge(docs).where("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose five-word shingles reach a similarity of 0.8 are linked. Of each component one row stays: of the smallest id (null ids come last), and of that id's rows the first."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("at"))
    rows = written(docs.withColumn("_row", row))  # written, so that a row's number stays
    stay = simhash.near_duplicates(rows, "_row", shingle=5, similarity=0.8).where("doc_id.at = component_id.at").select(F.col("doc_id.at").alias("at"))
    return rows.join(stay, F.col("_row.at") == F.col("at"), "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("hits.n_hit = 0").select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the new text."""
    found = secrets.with_spans(docs)
    text = secrets.redact(F.col("doc.text"), F.col("spans"))
    changed = F.size("spans") > 0
    columns = {"text": text, "n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("doc.n_chars"))}
    return found.select(*[columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as it is taken."""
    return mixing.emitted(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontam", decontamination), ("secrets", secret_scan), ("mixing", source_mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), work_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
