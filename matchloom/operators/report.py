"""The readable report, as one text block per ranked document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators.ranking import ranking_score

# Wording of the report.
TITLE = "Ranked Match Summary"
SECTION = "## Ranked Application Strategy"
NO_EVIDENCE = "Evidence mapping is limited."


def header_lines(candidate_id: str, run_dir: str, title: str = TITLE) -> list[str]:
    return [f"# {title}", "", f"- Candidate: `{candidate_id}`", f"- Run directory: `{run_dir}`", "", SECTION, ""]


def listed(items: Column, size: int) -> Column:
    return F.array_join(tx.head(items, size), ", ")


def or_text(text: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), default)


def report_blocks(strategies: DataFrame) -> DataFrame:
    """Rows (run_id, priority_rank, block) for strategies joined with document, score and explanation.

    Every block ends in an empty line; a run's report is its blocks in rank order.
    """
    evidence = or_text(listed(F.col("evidence_refs"), 3), F.lit(NO_EVIDENCE))
    revisions = or_text(listed(F.col("resume_revision_tasks"), 3), listed(F.col("recommended_actions"), 3))
    block = F.concat_ws(
        "\n",
        F.concat(
            F.lit("### "), F.col("priority_rank").cast("string"), F.lit(". "), F.col("title"), F.lit(" @ "),
            F.col("company"),
        ),
        F.concat(
            F.lit("- Apply decision: `"), F.col("apply_decision"), F.lit("` (confidence `"),
            sc.two_places(F.col("decision_confidence")), F.lit("`)"),
        ),
        F.concat(F.lit("- Why worth / not worth: "), F.col("reason_summary")),
        F.concat(F.lit("- Evidence that holds: "), evidence),
        F.concat(F.lit("- Interview danger points: "), listed(F.col("watchouts"), 4)),
        F.concat(F.lit("- If only revise 3 resume items: "), revisions),
        F.concat(
            F.lit("- Final score: `"), sc.two_places(ranking_score()), F.lit("` via `"),
            F.col("final_decision_source"), F.lit("`"),
        ),
        F.lit(""),
    )
    return strategies.select("run_id", "priority_rank", block.alias("block"))
