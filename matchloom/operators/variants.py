"""Document-specific variants of a candidate and their pairing with the documents they target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators.ordering import numbered

# Variant types and default phrases of the summaries.
JD_SPECIFIC = "jd-specific"
CLUSTER = "cluster"
DEFAULT_JD_STRENGTH = "cross-functional execution"
DEFAULT_CLUSTER_STRENGTH = "AI workflow delivery"


def jd_summary(title: Column, strengths: Column, keywords: Column) -> Column:
    lead = F.coalesce(F.get(strengths, F.lit(0)), F.lit(DEFAULT_JD_STRENGTH))
    keyword = tx.first_item(keywords, "document without keywords")
    return F.concat(
        title, F.lit(" variant focused on "), lead, F.lit(", "), keyword, F.lit(", and evidence-backed delivery.")
    )


def cluster_summary(cluster: Column, strengths: Column, documents: Column) -> Column:
    lead = F.coalesce(F.get(strengths, F.lit(0)), F.lit(DEFAULT_CLUSTER_STRENGTH))
    return F.concat(
        cluster,
        F.lit(" cluster resume emphasizing "),
        lead,
        F.lit(" across "),
        documents.cast("string"),
        F.lit(" related roles."),
    )


def emphasized_strengths(keywords: Column, evidence: Column, strengths: Column) -> Column:
    """Per keyword the first evidence line with its first word; duplicates stay, three at most."""

    def first_line(keyword: Column) -> Column:
        token = F.when(F.size(evidence) > 0, tx.first_token(keyword))
        return tx.once(
            token, lambda word: F.get(F.filter(evidence, lambda line: F.contains(F.lower(line), word)), F.lit(0))
        )

    matched = F.array_compact(F.transform(keywords, first_line))
    return tx.or_default(tx.head(matched, 3), tx.head(strengths, 2))


def stretch_points(keywords: Column, claim_text: Column) -> Column:
    """Up to three keywords the candidate does not mention, else the last keyword."""
    missing = tx.absent_from(keywords, claim_text, F.lower)
    last = F.element_at(keywords, -1)
    return tx.or_default(tx.head(missing, 3), F.array(last))


def jd_variants(jds: DataFrame, candidates: DataFrame) -> DataFrame:
    """One variant per document. ``candidates`` has one row per run, so this is a lookup join."""
    pairs = jds.join(candidates, "run_id")
    return pairs.select(
        "run_id",
        F.col("jd_index").alias("variant_ord"),
        F.concat(F.lit("variant-jd-"), F.col("jd_id")).alias("variant_id"),
        F.lit(JD_SPECIFIC).alias("variant_type"),
        F.col("cluster").alias("variant_cluster"),
        F.array("jd_id").alias("target_jd_ids"),
        jd_summary(F.col("title"), F.col("strengths"), F.col("keywords")).alias("summary"),
        emphasized_strengths(
            F.col("keywords"), F.concat("experiences", "skills"), F.col("strengths")
        ).alias("emphasized_strengths"),
        stretch_points(F.col("keywords"), F.col("claim_text")).alias("stretch_points"),
        F.col("base_resume_path").alias("source_resume_path"),
    )


def work_items(jds: DataFrame, variants: DataFrame) -> DataFrame:
    """Pairs of a document and each variant that targets it.

    Exploding the targets turns list containment into an equi-join: the number of pairs is the
    number of targets named, never documents times variants.
    """
    targeted = variants.withColumn("jd_id", F.explode(F.array_distinct("target_jd_ids")))
    return jds.join(targeted, ["run_id", "jd_id"])


def with_variant_index(items: DataFrame) -> DataFrame:
    """Number the variants of each document from 0, in variant order."""
    ordered = numbered(
        items, ["run_id", "jd_index"], ["variant_ord"], [F.col("variant_ord")], "variant_index", carry=True
    )
    return ordered.withColumn("variant_index", F.col("variant_index") - 1)


def in_task_order(items: DataFrame) -> DataFrame:
    """Number the pairs of each run from 1 (``task``): documents in input order, then their variants."""
    order = [F.col("jd_index"), F.col("variant_ord")]
    return numbered(items, ["run_id"], ["jd_index", "variant_ord"], order, "task", carry=True)
