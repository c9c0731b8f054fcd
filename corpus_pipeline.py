"""The training-data pipeline: toxic documents go, boilerplate lines go, one document of each group of near
duplicates stays, documents with benchmark passages go, and the rest is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of
``documents``; the last one returns ids. Rows with a null text pass every filter. A text that loses lines
gets a new ``n_chars``.

The line stage counts documents of a source as one where the least hash of their word shingles agrees, as it does
in copies and mostly in near copies, so these do not make their own lines boilerplate. A text of boilerplate
only stays as it was: the next stage reduces such groups to one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import bpe, decontaminate, line_dedup, near_dup, queries, toxicity
from matchloom.llm.storage import stored, unused_name


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the model learns from those with a label."""
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused_name(docs, "toxicity")
    return toxicity.scored(docs, model, score=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents of their source carry; documents of one sketch count as one."""
    before = unused_name(docs, "text_before")
    rows = line_dedup.without_boilerplate(
        docs.withColumn(before, F.col("text")), F.col("source"), unit=line_dedup.sketch(F.col("text")), keep_whole=True
    )
    changed = ~F.col("text").eqNullSafe(F.col(before))
    n_chars = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group."""
    return near_dup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and whether decoding gives the text back."""
    rows = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), queries.RANK_FILE, queries.PATTERN)
    rows = bpe.decoded(rows, queries.RANK_FILE)
    same = F.col("data") == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes_back")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: A trained model, components and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
