"""Rule scores and gaps of (document, candidate, variant) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators.variants import CLUSTER

# Rewrite distance and reuse per variant type, and the score weights.
REWRITE_DISTANCE = {"cluster": 0.28, "other": 0.42}
CLUSTER_REUSE = {"cluster": 0.85, "other": 0.55}
FIT_WEIGHTS = {"keywords": 0.6, "evidence": 0.4}
STRETCH_BASE, STRETCH_FLOOR = 0.9, 0.1
GAP_RISK_WEIGHTS = {"keywords": 0.45, "evidence": 0.35, "flags": 0.2}
GAP_RISK_CEILING = 0.95
REWRITE_DISTANCE_WEIGHT = 0.15
OVERALL_WEIGHTS = {"fit": 0.32, "ats": 0.16, "evidence": 0.2, "stretch": 0.1, "gap_risk": 0.17, "rewrite_cost": 0.05}

# Texts of a gap item.
GAP_AREA = "Role alignment"
GAP_STATE = "Relevant foundation from current resume and projects"
GAP_TARGET = "Confidently discuss "
HIGH, MEDIUM = "high", "medium"


def with_jd_norms(jds: DataFrame) -> DataFrame:
    """Normalise keywords and document text once per document, before it meets its variants."""
    whole = tx.spaced(F.col("responsibilities"), F.col("requirements"), F.col("keywords"), F.col("bonuses"))
    return jds.withColumn("jd_text", tx.normalised(whole))


def with_variant_norms(variants: DataFrame) -> DataFrame:
    whole = tx.spaced(F.array("summary"), F.col("emphasized_strengths"), F.col("stretch_points"))
    return variants.withColumns(
        {
            "variant_text": tx.normalised(whole),
            "strength_needles": F.transform("emphasized_strengths", tx.normalised),
            "point_needles": F.transform("stretch_points", tx.normalised),
        }
    )


def with_candidate_hits(documents: DataFrame) -> DataFrame:
    """What a document's keywords find in its candidate, once per document and not once per variant of it.

    ``documents`` are joined with their candidates. Added are the normalised keywords, which of them the
    candidate's text has, the gaps, and the candidate's lines that back a keyword.
    """
    needles = documents.withColumn("keyword_needles", F.transform("keywords", tx.normalised))
    return needles.withColumns(
        {
            "candidate_hits": F.transform("keyword_needles", lambda needle: F.contains(F.col("rule_text"), needle)),
            "gaps": gap_items(F.col("keywords"), F.col("gap_text")),
            "matched_lines": matched_evidence(),
        }
    ).drop("gap_text", "claim_text")


def matched_evidence() -> Column:
    """Candidate lines that hold the first word of some keyword (the line lower-cased, the word as is)."""
    lines = F.concat("experiences", "projects", "skills", "verified_evidence")
    tokens = F.when(F.size(lines) > 0, F.transform("keywords", tx.first_token))

    def holds(line: Column, words: Column) -> Column:
        return tx.once(F.lower(line), lambda lowered: F.exists(words, lambda word: F.contains(lowered, word)))

    return tx.once(tokens, lambda words: F.filter(lines, lambda line: holds(line, words)))


def evidence_columns(pairs: DataFrame) -> DataFrame:
    """Add coverage, binding and untraceable claims to pairs of ``with_candidate_hits`` and ``with_variant_norms`` rows.

    An item without ASCII letters or digits normalises to an empty text, which every text
    contains: it always counts as found.
    """
    in_variant, in_candidate = F.col("variant_text"), F.col("rule_text")

    def covered(keyword: Column, at: Column) -> Column:
        return F.get("candidate_hits", at) | F.contains(in_variant, F.get("keyword_needles", at))

    def bound(needle: Column) -> Column:
        return F.contains(in_candidate, needle)

    def untraceable(point: Column, at: Column) -> Column:
        needle = F.get("point_needles", at)
        return ~F.contains(in_candidate, needle) & ~F.contains(F.col("jd_text"), needle)

    keywords, strengths, points = F.col("keywords"), F.col("emphasized_strengths"), F.col("stretch_points")
    found = pairs.withColumns(
        {
            "keyword_hits": F.filter(keywords, covered),
            "_bound": F.size(F.filter("strength_needles", bound)),
            "untraceable_claim_flags": F.filter(points, untraceable),
        }
    )
    return found.withColumns(
        {
            "keyword_coverage": sc.ratio(F.size("keyword_hits"), F.size(keywords)),
            "evidence_binding": sc.ratio(F.col("_bound"), F.size(strengths)),
            "flag_ratio": sc.ratio(F.size("untraceable_claim_flags"), F.greatest(F.lit(1), F.size(points))),
        }
    ).drop("_bound", "strength_needles", "point_needles")


def by_variant_type(values: dict[str, float]) -> Column:
    return F.when(F.col("variant_type") == CLUSTER, F.lit(values["cluster"])).otherwise(F.lit(values["other"]))


def score_columns(pairs: DataFrame) -> DataFrame:
    """Add the six scores and their weighted total, all from two-decimal inputs."""
    coverage, binding, flags = F.col("keyword_coverage"), F.col("evidence_binding"), F.col("flag_ratio")
    risk = (
        (1 - coverage) * F.lit(GAP_RISK_WEIGHTS["keywords"])
        + (1 - binding) * F.lit(GAP_RISK_WEIGHTS["evidence"])
        + flags * F.lit(GAP_RISK_WEIGHTS["flags"])
    )
    fit = coverage * F.lit(FIT_WEIGHTS["keywords"]) + binding * F.lit(FIT_WEIGHTS["evidence"])
    distance, reuse = by_variant_type(REWRITE_DISTANCE), by_variant_type(CLUSTER_REUSE)
    scored = pairs.withColumns(
        {
            "rewrite_distance": distance,
            "cluster_reuse_efficiency": reuse,
            "fit_score": sc.bounded(fit),
            "ats_score": sc.bounded(coverage),
            "evidence_score": sc.bounded(binding),
            "stretch_score": sc.bounded(F.greatest(F.lit(STRETCH_FLOOR), F.lit(STRETCH_BASE) - flags)),
            "gap_risk_score": sc.bounded(F.least(F.lit(GAP_RISK_CEILING), risk)),
            "rewrite_cost_score": sc.bounded(1 - reuse + distance * F.lit(REWRITE_DISTANCE_WEIGHT)),
        }
    )
    weight = OVERALL_WEIGHTS
    total = (
        F.col("fit_score") * F.lit(weight["fit"])
        + F.col("ats_score") * F.lit(weight["ats"])
        + F.col("evidence_score") * F.lit(weight["evidence"])
        + F.col("stretch_score") * F.lit(weight["stretch"])
        + (1 - F.col("gap_risk_score")) * F.lit(weight["gap_risk"])
        + (1 - F.col("rewrite_cost_score")) * F.lit(weight["rewrite_cost"])
    )
    return scored.withColumn("overall_score", sc.bounded(total))


def gap_items(keywords: Column, gap_text: Column) -> Column:
    """No item when every keyword occurs in experiences, projects and skills, else exactly one."""

    def items(missing: Column) -> Column:
        named = tx.head(missing, 2)
        item = F.struct(
            F.lit(GAP_AREA).alias("area"),
            F.lit(GAP_STATE).alias("current_state"),
            F.concat(F.lit(GAP_TARGET), F.array_join(named, ", ")).alias("target_state"),
            F.when(F.size(missing) >= 2, F.lit(HIGH)).otherwise(F.lit(MEDIUM)).alias("priority"),
            tx.head(missing, 3).alias("catch_up_concepts"),
            F.transform(
                named, lambda word: F.concat(F.lit("Evidence for "), word, F.lit(" is currently indirect."))
            ).alias("weak_points"),
        )
        return F.slice(F.array(item), 1, F.least(F.size(missing), F.lit(1)))

    return tx.once(tx.absent_from(keywords, gap_text), items)


def rule_evaluations(pairs: DataFrame) -> DataFrame:
    """All rule columns of the work items; a projection without any shuffle."""
    return score_columns(evidence_columns(pairs)).drop("keyword_needles", "candidate_hits")
