"""The driver tables read as engine inputs.

``documents`` are the target documents, ``benchmark`` items the candidates (one run each), and a
document belongs to run ``doc_id`` modulo the number of items. Everything is derived row by row
or by joins on keys, so the work grows with the tables and no table is paired with a whole other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators import candidate as cand
from matchloom.operators import judge, parse, variants

LEXICON_SIZE = 9
LEXICON_TOKEN = 4
PROJECT_WORDS = ("tion", "heit")


# Declared, so that opening a table starts no job to look into its files.
SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores if the input has fewer splits than there are cores.

    Row-wise text work on a table of one row group would run in one task. A large input has splits enough
    and is left as it is, so nothing is shuffled there.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def lexicon(spark: SparkSession, folder: str) -> Column:
    """The most frequent longer words of ``benchmark`` as a lexicon value: a scalar subquery of nine entries."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    counted = (
        table(spark, folder, "benchmark")
        .select(F.explode(words).alias("word"))
        .filter(F.length("word") >= LEXICON_TOKEN)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(LEXICON_SIZE)
    )
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "word")))
    as_pairs = F.transform(entries, lambda e: F.struct(e["word"].alias("needle"), e["word"].alias("label")))
    return counted.agg(as_pairs.alias("lexicon")).scalar()


def run_count(spark: SparkSession, folder: str) -> Column:
    return table(spark, folder, "benchmark").agg(F.count("*")).scalar()


def as_bullets(text: Column) -> Column:
    """Every sentence and line as a bullet."""
    flat = F.replace(text, F.lit("\n"), F.lit(". "))
    return F.concat(F.lit("- "), F.replace(flat, F.lit(". "), F.lit("\n- ")))


def as_block(text: Column, company: Column) -> Column:
    return F.concat(
        F.lit("Title: "), F.substring_index(text, " ", 3), F.lit("\nCompany: "), company, F.lit("\nBody:\n"),
        as_bullets(text),
    )


def jd_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Input texts with one block per line of a document; the run is the language."""
    blocks = F.transform(
        F.split("text", "\n"), lambda line: F.concat(F.lit(parse.BLOCK_MARK + "\n"), as_block(line, F.col("source")))
    )
    return documents(spark, folder).select(
        F.col("lang").alias("run_id"),
        F.col("doc_id").alias("input_ord"),
        F.lit("file").alias("source_type"),
        F.format_string("doc-%d.txt", "doc_id").alias("source_value"),
        F.array_join(blocks, "\n").alias("content"),
    )


def jd_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One block per document, numbered by the document itself."""
    return documents(spark, folder).select(
        (F.col("doc_id") % run_count(spark, folder)).alias("run_id"),
        F.col("doc_id").alias("jd_index"),
        F.format_string("jd-%d", "doc_id").alias("jd_id"),
        F.lit("file").alias("source_type"),
        F.format_string("doc-%d.txt", "doc_id").alias("source_value"),
        as_block(F.col("text"), F.col("source")).alias("block"),
    )


def jd_profiles(spark: SparkSession, folder: str) -> DataFrame:
    blocks = jd_blocks(spark, folder).withColumn("lexicon", lexicon(spark, folder))
    return parse.jd_profiles(blocks, F.col("lexicon"))


def cv_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate documents of a run: the turns of a conversation."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("input_ord"),
        F.format_string("conv-%d/turn-%d.md", "conv_id", "turn").alias("source_value"),
        as_bullets(F.col("text")).alias("text"),
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    resumes = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("run_id"),
        F.format_string("cand-%d", "item_id").alias("candidate_id"),
        F.format_string("item-%d.md", "item_id").alias("base_resume_path"),
        as_bullets(F.col("text")).alias("resume_text"),
    ).withColumn("lexicon", lexicon(spark, folder))
    return cand.candidate_profiles(resumes, F.col("lexicon"), PROJECT_WORDS)


def resume_variants(jds: DataFrame, people: DataFrame, runs: Column) -> DataFrame:
    """The variant made for each document and one shared with the next document of the run."""
    kinds = F.explode(F.array(F.lit(variants.JD_SPECIFIC), F.lit(variants.CLUSTER))).alias("variant_type")
    made = jds.join(cand.with_match_texts(people), "run_id").select("*", kinds)
    made = made.withColumn("next_jd", F.format_string("jd-%d", F.col("jd_index") + runs))
    specific = F.col("variant_type") == variants.JD_SPECIFIC
    keywords, strengths = F.col("keywords"), F.col("strengths")

    def either(single: Column, shared: Column) -> Column:
        return F.when(specific, single).otherwise(shared)

    targets = F.array("jd_id", "next_jd")
    return made.select(
        "run_id",
        (F.col("jd_index") * 2 + either(F.lit(0), F.lit(1))).alias("variant_ord"),
        F.concat(either(F.lit("variant-jd-"), F.lit("variant-cluster-")), "jd_id").alias("variant_id"),
        "variant_type",
        F.col("cluster").alias("variant_cluster"),
        either(F.array("jd_id"), targets).alias("target_jd_ids"),
        either(
            variants.jd_summary(F.col("title"), strengths, keywords),
            variants.cluster_summary(F.col("cluster"), strengths, F.size(targets)),
        ).alias("summary"),
        either(
            variants.emphasized_strengths(keywords, F.concat("experiences", "skills"), strengths),
            tx.head(F.concat("requirements", "strengths"), 2),
        ).alias("emphasized_strengths"),
        either(
            variants.stretch_points(keywords, F.col("claim_text")),
            tx.head(F.concat(tx.head(keywords, 2), "must_have_requirements"), 3),
        ).alias("stretch_points"),
        F.col("base_resume_path").alias("source_resume_path"),
    )


def label_outcomes(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge outcomes by label: none without a label, incomplete or unusable with the bad ones."""
    marks = labels.select(F.col("doc_id").alias("jd_index"), "quality", "toxic")
    joined = judged.join(marks, "jd_index", "left")
    unlabelled, poor, toxic = F.col("quality").isNull(), F.col("quality") == 0, F.col("toxic") == 1
    return (
        joined.withColumn("error_type", F.when(unlabelled, F.lit("LookupError")))
        .withColumn("error_message", F.when(unlabelled, F.concat(F.lit("no label for "), "jd_id")))
        .withColumn("evidence_citations", F.when(poor, tx.no_texts()).otherwise(F.col("evidence_citations")))
        .withColumn("decision_rationale", F.when(toxic, F.lit("")).otherwise(F.col("decision_rationale")))
        .withColumn(
            "application_worthiness", F.when(poor & toxic, F.lit(" ")).otherwise(F.col("application_worthiness"))
        )
        .drop("quality", "toxic")
    )


def with_judge(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return label_outcomes(judge.with_assessment(judge.with_review(pairs)), labels)


def event_scorecards(spark: SparkSession, folder: str) -> DataFrame:
    """Scorecards out of events: the document is the user, scores come from the value and repeat often."""
    value = F.col("value")

    def score(divisor: int) -> Column:
        return (F.floor(value * 100).cast("long") % divisor).cast("double") / F.lit(100.0)

    return table(spark, folder, "events").select(
        F.col("event_type").alias("run_id"),
        F.col("user_id").alias("jd_index"),
        F.format_string("jd-%d", "user_id").alias("jd_id"),
        F.col("event_id").alias("variant_ord"),
        F.format_string("variant-%d", "event_id").alias("variant_id"),
        score(7).alias("final_overall_score"),
        score(11).alias("overall_score"),
        score(3).alias("fit_score"),
        score(5).alias("evidence_score"),
        score(4).alias("gap_risk_score"),
    )
