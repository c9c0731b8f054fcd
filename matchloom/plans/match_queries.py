"""Variant, scoring, judging, ranking and reporting queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import explain, judge, ranking, report, strategy, variants, viewer
from matchloom.plans import adapters as ad
from matchloom.plans import oracle as sql
from matchloom.plans import stages
from matchloom.plans.parse_queries import shown
from matchloom.plans.registry import ORACLES, registered
from matchloom.session import durable
from matchloom.sources.records import checked


def made_variants(spark: SparkSession, folder: str) -> DataFrame:
    return inputs(spark, folder)[2]


def inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, candidates and variants."""
    documents, people = ad.jd_profiles(spark, folder), ad.candidates(spark, folder)
    return documents, people, ad.resume_variants(documents, people, ad.run_count(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return stages.scored_pairs(*inputs(spark, folder))


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    return stages.settled(ad.with_judge(scored(spark, folder), ad.table(spark, folder, "labels")))


def counted(array: str | Column) -> Column:
    return F.size(array).cast("long")


@registered(
    "variant_summary",
    sql.query("SELECT variant_ord, variant_id, variant_type, summary, array_to_string(target_jd_ids, ',') AS targets FROM variant"),
)
def variant_summary(spark: SparkSession, folder: str) -> DataFrame:
    return made_variants(spark, folder).select(
        "variant_ord", "variant_id", "variant_type", "summary", F.array_join("target_jd_ids", ",").alias("targets")
    )


@registered(
    "emphasized_strengths",
    sql.query(f"SELECT variant_id, {sql.joined('emphasized_strengths')} AS emphasized FROM variant"),
)
def emphasized_strengths(spark: SparkSession, folder: str) -> DataFrame:
    return made_variants(spark, folder).select("variant_id", shown("emphasized_strengths").alias("emphasized"))


@registered(
    "stretch_points", sql.query(f"SELECT variant_id, {sql.joined('stretch_points')} AS stretch FROM variant")
)
def stretch_points(spark: SparkSession, folder: str) -> DataFrame:
    return made_variants(spark, folder).select("variant_id", shown("stretch_points").alias("stretch"))


@registered(
    "relevant_variants",
    sql.query(
        """SELECT run_id, jd_id, variant_id,
        row_number() OVER (PARTITION BY run_id, jd_index ORDER BY variant_ord) - 1 AS variant_index
        FROM jd JOIN target USING (run_id, jd_id)"""
    ),
)
def relevant_variants(spark: SparkSession, folder: str) -> DataFrame:
    documents = ad.jd_blocks(spark, folder).select("run_id", "jd_index", "jd_id")
    items = variants.work_items(documents, made_variants(spark, folder))
    return variants.with_variant_index(
        items.select("run_id", "jd_index", "jd_id", "variant_id", "variant_ord")
    ).select("run_id", "jd_id", "variant_id", "variant_index")


@registered(
    "task_order",
    sql.query(
        """SELECT run_id, jd_id, variant_id, row_number() OVER (PARTITION BY run_id ORDER BY jd_index, variant_ord) AS task
        FROM jd JOIN target USING (run_id, jd_id)"""
    ),
)
def task_order(spark: SparkSession, folder: str) -> DataFrame:
    documents = ad.jd_blocks(spark, folder).select("run_id", "jd_index", "jd_id")
    items = variants.work_items(documents, made_variants(spark, folder))
    return variants.in_task_order(items.select("run_id", "jd_index", "jd_id", "variant_id", "variant_ord")).select(
        "run_id", "jd_id", "variant_id", "task"
    )


@registered(
    "keyword_coverage",
    sql.query(f"SELECT jd_id, variant_id, {sql.joined('keyword_hits')} AS hits, kc AS coverage FROM shares"),
)
def keyword_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select(
        "jd_id", "variant_id", shown("keyword_hits").alias("hits"), F.col("keyword_coverage").alias("coverage")
    )


@registered(
    "evidence_binding",
    sql.query("SELECT jd_id, variant_id, len(emphasized_strengths) AS strengths, eb AS binding FROM shares"),
)
def evidence_binding(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select(
        "jd_id",
        "variant_id",
        counted("emphasized_strengths").alias("strengths"),
        F.col("evidence_binding").alias("binding"),
    )


@registered(
    "untraceable_claims",
    sql.query(f"SELECT jd_id, variant_id, {sql.joined('untraceable')} AS claims, fr AS flag_ratio FROM shares"),
)
def untraceable_claims(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select(
        "jd_id", "variant_id", shown("untraceable_claim_flags").alias("claims"), "flag_ratio"
    )


RULE_SCORES = [
    "fit_score",
    "ats_score",
    "evidence_score",
    "stretch_score",
    "gap_risk_score",
    "rewrite_cost_score",
    "overall_score",
]


@registered("rule_scores", sql.query(f"SELECT run_id, jd_id, variant_id, {', '.join(RULE_SCORES)} FROM rule"))
def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("run_id", "jd_id", "variant_id", *RULE_SCORES)


@registered(
    "gap_items",
    sql.query(
        f"""SELECT jd_id, variant_id, gap_count::BIGINT AS gap_count, CASE WHEN gap_count > 0 THEN target_state END AS target_state,
        CASE WHEN gap_count > 0 THEN priority END AS priority,
        CASE WHEN gap_count > 0 THEN {sql.joined('lacking[1:3]')} END AS catch_up,
        CASE WHEN gap_count > 0 THEN {sql.joined('weak_points')} END AS weak_points FROM rule"""
    ),
)
def gap_items(spark: SparkSession, folder: str) -> DataFrame:
    item = F.get("gaps", F.lit(0))
    return scored(spark, folder).select(
        "jd_id",
        "variant_id",
        counted("gaps").alias("gap_count"),
        item["target_state"].alias("target_state"),
        item["priority"].alias("priority"),
        shown(item["catch_up_concepts"]).alias("catch_up"),
        shown(item["weak_points"]).alias("weak_points"),
    )


@registered(
    "deterministic_assessment",
    sql.query(
        f"""SELECT jd_id, variant_id, role_fit, evidence_quality, persuasiveness, risk AS interview_pressure_risk,
        worth AS application_worthiness, said AS decision_rationale, {sql.joined('verified_evidence[1:3]')} AS citations,
        {sql.joined('stretch_points[1:2]')} AS rewrites,
        variant_type || ' variant aligns ' || candidate_id || ' with ' || title || '; score indicates '
            || CASE WHEN overall_score >= 0.7e0 THEN 'manageable risk' ELSE 'meaningful catch-up risk' END
            || ' for this batch.' AS judge_rationale FROM assess"""
    ),
)
def deterministic_assessment(spark: SparkSession, folder: str) -> DataFrame:
    return judge.with_assessment(judge.with_review(scored(spark, folder))).select(
        "jd_id",
        "variant_id",
        "role_fit",
        "evidence_quality",
        "persuasiveness",
        "interview_pressure_risk",
        "application_worthiness",
        "decision_rationale",
        shown("evidence_citations").alias("citations"),
        shown("rewrite_opportunities").alias("rewrites"),
        "judge_rationale",
    )


@registered(
    "judge_overall",
    f"""SELECT event_id, {sql.r2('a * 0.35e0 + b * 0.25e0 + c * 0.2e0 + (1 - d) * 0.2e0')} AS llm_overall
    FROM (SELECT event_id, (v % 101) / 100e0 AS a, (v % 97) / 100e0 AS b, (v % 89) / 100e0 AS c, (v % 83) / 100e0 AS d
          FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS v FROM events))""",
)
def judge_overall(spark: SparkSession, folder: str) -> DataFrame:
    cents = F.floor(F.col("value") * 100).cast("long")

    def score(divisor: int) -> Column:
        return (cents % divisor).cast("double") / F.lit(100.0)

    return (
        ad.table(spark, folder, "events")
        .select(
            "event_id",
            score(101).alias("role_fit"),
            score(97).alias("evidence_quality"),
            score(89).alias("persuasiveness"),
            score(83).alias("interview_pressure_risk"),
        )
        .select("event_id", judge.judge_overall().alias("llm_overall"))
    )


@registered(
    "guardrails",
    sql.query(
        f"""SELECT jd_id, variant_id, llm_overall AS llm_overall_score, final_overall_score,
        source AS final_decision_source, {sql.joined('flags')} AS guardrail_flags FROM final"""
    ),
)
def guardrails(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder).select(
        "jd_id",
        "variant_id",
        "llm_overall_score",
        "final_overall_score",
        "final_decision_source",
        shown("guardrail_flags").alias("guardrail_flags"),
    )


@registered(
    "judge_failures",
    sql.query(
        """SELECT jd_id, variant_id, 'evaluate' AS stage, split_part(failure, ': ', 1) AS error_type,
        split_part(failure, ': ', 2) AS error_message FROM final WHERE NOT assessed"""
    ),
)
def judge_failures(spark: SparkSession, folder: str) -> DataFrame:
    return judge.failure_rows(evaluated(spark, folder)).select(
        "jd_id", "variant_id", "stage", "error_type", "error_message"
    )


@registered(
    "evaluate_counts",
    sql.query(
        """SELECT count(*) AS tasks, count(*) FILTER (WHERE assessed) AS ok,
        count(*) FILTER (WHERE NOT assessed) AS fallback FROM final"""
    ),
)
def evaluate_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder).agg(
        F.count("*").alias("tasks"),
        F.count_if("assessed").alias("ok"),
        F.count_if(~F.col("assessed")).alias("fallback"),
    )


@registered(
    "gap_map_best",
    sql.query(
        f"""SELECT jd.run_id, jd.jd_id, cand.candidate_id, coalesce(gap_count, 0)::BIGINT AS gap_count,
        coalesce(array_to_string(lacking[1:3], ' | '), '') AS catch_up
        FROM jd JOIN cand USING (run_id) LEFT JOIN (
            SELECT run_id, jd_index, max_by(gap_count, ROW(overall_score, -variant_ord)) AS gap_count,
                   max_by(lacking, ROW(overall_score, -variant_ord)) AS lacking
            FROM rule GROUP BY run_id, jd_index) g ON g.run_id = jd.run_id AND g.jd_index = jd.jd_index"""
    ),
)
def gap_map_best(spark: SparkSession, folder: str) -> DataFrame:
    documents, people, made = inputs(spark, folder)
    gaps = ranking.gap_maps(documents, people, stages.scored_pairs(documents, people, made))
    concepts = F.get("items", F.lit(0))["catch_up_concepts"]
    return gaps.select(
        "run_id",
        "jd_id",
        "candidate_id",
        counted("items").alias("gap_count"),
        F.coalesce(shown(concepts), F.lit("")).alias("catch_up"),
    )


@registered(
    "eval_summary",
    sql.query(
        f"""SELECT run_id, jd_id, title, variant_id AS top_variant_id, gap_count::BIGINT AS gap_count,
        {sql.joined('reasons')} AS top_reasons FROM summary"""
    ),
)
def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.eval_summary(evaluated(spark, folder)).select(
        "run_id", "jd_id", "title", "top_variant_id", "gap_count", shown("top_reasons").alias("top_reasons")
    )


@registered(
    "best_per_jd",
    sql.query(
        """SELECT run_id, 'jd-' || jd_index AS jd_id, 'variant-' || variant_ord AS variant_id, final_overall_score,
        fit_score, evidence_score, gap_risk_score FROM event_best"""
    ),
)
def best_per_jd(spark: SparkSession, folder: str) -> DataFrame:
    scores = ["final_overall_score", "fit_score", "evidence_score", "gap_risk_score"]
    return ranking.best_per_jd(ad.event_scorecards(spark, folder), ["variant_id", *scores]).select(
        "run_id", "jd_id", "variant_id", *scores
    )


@registered(
    "priority_rank",
    sql.query(
        f"""SELECT run_id, 'jd-' || jd_index AS jd_id, 'variant-' || variant_ord AS variant_id,
        row_number() OVER (PARTITION BY run_id ORDER BY {sql.FINAL} DESC, fit_score DESC, evidence_score DESC,
            gap_risk_score, jd_index) AS priority_rank FROM event_best"""
    ),
)
def priority_rank(spark: SparkSession, folder: str) -> DataFrame:
    best = ranking.best_per_jd(ad.event_scorecards(spark, folder), ["variant_id"])
    return ranking.priority_ranks(best).select("run_id", "jd_id", "variant_id", "priority_rank")


REASONS = ("fit", "ats", "evidence", "stretch", "gap_risk", "rewrite_cost", "overall")


@registered(
    "ranking_explanation",
    sql.query(
        f"""SELECT jd_id, variant_id, reason_fit AS fit, 'keyword_coverage=' || {sql.fmt('kc')} AS ats,
        reason_evidence AS evidence, 'stretch=' || {sql.fmt('stretch_score')} AS stretch,
        'gap_risk=' || {sql.fmt('gap_risk_score')} AS gap_risk,
        'rewrite_cost=' || {sql.fmt('rewrite_cost_score')} AS rewrite_cost, told AS overall,
        {sql.joined('signals')} AS positive_signals, {sql.joined('risk_flags')} AS risk_flags,
        {sql.joined('refs')} AS evidence_refs FROM expl"""
    ),
)
def ranking_explanation(spark: SparkSession, folder: str) -> DataFrame:
    rows = explain.explanation_rows(evaluated(spark, folder))
    return rows.select(
        "jd_id",
        "variant_id",
        *[F.col("dimension_reasons")[name].alias(name) for name in REASONS],
        *[shown(column).alias(column) for column in ("positive_signals", "risk_flags", "evidence_refs")],
    )


@registered(
    "legacy_explanation",
    sql.query(
        f"""SELECT expl.jd_id, expl.variant_id,
        'Legacy run fallback for ' || expl.variant_id || ': final_score=' || {sql.fmt(sql.FINAL)}
            || ', gap_risk_score=' || {sql.fmt('gap_risk_score')} || '.' AS overall,
        'final_score=' || {sql.fmt(sql.FINAL)} || ' from legacy scorecard' AS signal,
        coalesce(g.weak_points[1], '') AS risk_flags,
        variant_type || ' variant aligns ' || candidate_id || ' with ' || expl.title || '; score indicates '
            || CASE WHEN overall_score >= 0.7e0 THEN 'manageable risk' ELSE 'meaningful catch-up risk' END
            || ' for this batch.' AS decision_summary
        FROM expl JOIN (SELECT run_id, jd_index, weak_points FROM summary) g
          ON g.run_id = expl.run_id AND g.jd_index = expl.jd_index
        WHERE NOT assessed"""
    ),
)
def legacy_explanation(spark: SparkSession, folder: str) -> DataFrame:
    """Only accepted assessments kept their explanation; the rest get a made-up one."""
    rows, gaps, _ = viewer_tables(spark, folder)
    stored = explain.explanation_rows(rows.filter("assessed"))
    whole = explain.complete_explanations(stored, stages.scorecards(rows), gaps)
    made_up = whole.filter(F.startswith(F.col("dimension_reasons")["fit"], F.lit("Legacy")))
    return made_up.select(
        "jd_id",
        "variant_id",
        F.col("dimension_reasons")["overall"].alias("overall"),
        F.get("positive_signals", F.lit(0)).alias("signal"),
        shown("risk_flags").alias("risk_flags"),
        "decision_summary",
    )


@registered(
    "strategy",
    sql.query(
        f"""SELECT run_id, jd_id, variant_id AS recommended_variant_id, priority_rank, apply_decision, reason_summary,
        variant_type = 'jd-specific' AS needs_jd_specific_variant, confidence AS decision_confidence,
        {sql.joined('drivers')} AS decision_drivers, {sql.joined('watchouts')} AS watchouts,
        {sql.joined('actions')} AS recommended_actions, 'Large-scale online experiment ownership' AS catch_up_notes,
        {sql.joined('keywords[1:3]')} AS interview_prep_points, {sql.joined('tasks')} AS resume_revision_tasks
        FROM strat"""
    ),
)
def strategies(spark: SparkSession, folder: str) -> DataFrame:
    lists = [
        "decision_drivers",
        "watchouts",
        "recommended_actions",
        "catch_up_notes",
        "interview_prep_points",
        "resume_revision_tasks",
    ]
    plain = [column for column in strategy.STRATEGY_COLUMNS if column not in lists]
    return stages.strategies(evaluated(spark, folder)).select(
        *plain, *[shown(column).alias(column) for column in lists]
    )


@registered(
    "report_lines",
    sql.query(
        f"""SELECT run_id, priority_rank, array_to_string([
        '### ' || priority_rank || '. ' || title || ' @ ' || company,
        '- Apply decision: `' || apply_decision || '` (confidence `' || {sql.fmt('confidence')} || '`)',
        '- Why worth / not worth: ' || reason_summary,
        '- Evidence that holds: ' || coalesce(nullif(array_to_string(refs[1:3], ', '), ''),
            'Evidence mapping is limited.'),
        '- Interview danger points: ' || array_to_string(watchouts[1:4], ', '),
        '- If only revise 3 resume items: ' || coalesce(nullif(array_to_string(tasks[1:3], ', '), ''),
            array_to_string(actions[1:3], ', ')),
        '- Final score: `' || {sql.fmt(sql.FINAL)} || '` via `' || source || '`', ''], chr(10)) AS block FROM strat"""
    ),
)
def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    return report.report_blocks(stages.strategies(evaluated(spark, folder)))


@registered("report_joins", ORACLES["report_lines"])
def report_joins(spark: SparkSession, folder: str) -> DataFrame:
    """The report once more, its parts joined from strategies, documents, scorecards and explanations."""
    rows = stored_evaluations(spark, folder)
    plans = stages.strategies(rows).select(*strategy.STRATEGY_COLUMNS)
    documents = ad.jd_profiles(spark, folder).select("run_id", "jd_index", "jd_id", "title", "company")
    return report.report_blocks(stages.report_joined(plans, documents, stages.scorecards(rows), explain.explanation_rows(rows)))


SUMMARY_COLUMNS = ["title", "positive_signals", "decision_summary", "gaps"]
STORED_COLUMNS = [*stages.PLAN_COLUMNS, *explain.EXPLANATION_COLUMNS, "gaps"]


def stored_evaluations(spark: SparkSession, folder: str, columns: list[str] = STORED_COLUMNS) -> DataFrame:
    """Scorecards and ``columns`` written once, as the stage boundary does, for plans that read them several times."""
    return durable(evaluated(spark, folder).select(*dict.fromkeys([*stages.SCORECARD_COLUMNS, *columns])))


def viewer_tables(
    spark: SparkSession, folder: str, columns: list[str] = STORED_COLUMNS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evaluations, gap maps and top variants of the runs."""
    rows = stored_evaluations(spark, folder, columns)
    documents = ad.jd_profiles(spark, folder).select("run_id", "jd_index", "jd_id", "title")
    gaps = ranking.gap_maps(documents, ad.candidates(spark, folder), rows)
    tops = viewer.top_variants(ranking.eval_summary(rows), stages.scorecards(rows), documents, gaps)
    return rows, gaps, tops


@registered(
    "top_variants",
    sql.query(
        f"""SELECT run_id, jd_id, title, variant_id,
        CASE WHEN starts_with(variant_id, 'variant-jd-') THEN '岗位定制版本（' || substr(variant_id, 12) || '）'
             ELSE '岗位簇版本（' || substr(variant_id, 17) || '）' END AS variant_display_name,
        score, gap_count::BIGINT AS gap_count, {sql.joined('reasons')} AS top_reasons
        FROM (SELECT * REPLACE (coalesce(nullif(title, ''), jd_id) AS title) FROM summary)"""
    ),
)
def top_variants(spark: SparkSession, folder: str) -> DataFrame:
    return viewer_tables(spark, folder, SUMMARY_COLUMNS)[2].select(
        "run_id", "jd_id", "title", "variant_id", "variant_display_name", "score", "gap_count",
        shown("top_reasons").alias("top_reasons"),
    )


@registered(
    "priority_matrix",
    sql.query(
        f"""SELECT s.run_id, s.jd_id, s.variant_id,
        row_number() OVER (PARTITION BY s.run_id ORDER BY s.score DESC, s.jd_index) AS position,
        CAST(floor(greatest(0e0, least(1e0, s.score)) * 100 + 0.5e0) AS BIGINT) AS score_percent,
        fit_score, gap_risk_score, apply_decision, {sql.joined('s.reasons')} AS signals,
        {sql.joined('strat.risk_flags')} AS risk_flags
        FROM summary s JOIN strat ON strat.run_id = s.run_id AND strat.jd_id = s.jd_id"""
    ),
)
def priority_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows, _, tops = viewer_tables(spark, folder)
    plans = stages.strategies(rows)
    matrix = viewer.priority_matrix(tops, stages.scorecards(rows), explain.explanation_rows(rows), plans)
    return matrix.select(
        "run_id", "jd_id", "variant_id", "position", "score_percent", "fit_score", "gap_risk_score", "apply_decision",
        shown("signals").alias("signals"), shown("risk_flags").alias("risk_flags"),
    )


def kept_once(*lists: str) -> str:
    """First occurrences, in order, of the trimmed non-blank items."""
    items = f"list_filter(list_transform(list_concat({', '.join(lists)}), lambda t: {sql.strip('t')}), lambda t: t <> '')"
    return f"list_filter({items}, lambda t, i: list_position({items}, t) = i)"


@registered(
    "report_summary",
    sql.query(
        f"""SELECT s.run_id, '优先投递 ' || s.title || '，综合得分 '
            || CAST(floor(s.score * 100 + 0.5e0) AS BIGINT) || '%。 | 投递决策：' || t.apply_decision || '。'
            || t.reason_summary AS recommendations,
        {sql.joined(kept_once('t.refs', 't.signals', 't.drivers', 's.reasons'))} AS evidence,
        {sql.joined(kept_once("['Large-scale online experiment ownership']", 't.keywords[1:3]', 't.actions',
            f"CASE WHEN s.gap_count > 0 THEN list_concat(s.lacking[1:3], s.weak_points) ELSE {sql.TEXTS} END",
            't.risk_flags'))} AS interview_prep
        FROM (SELECT * REPLACE (coalesce(nullif(title, ''), jd_id) AS title), row_number() OVER (PARTITION BY run_id
              ORDER BY score DESC, jd_index) AS place FROM summary) s
        JOIN strat t ON t.run_id = s.run_id AND t.jd_id = s.jd_id WHERE s.place = 1"""
    ),
)
def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows, gaps, tops = viewer_tables(spark, folder)
    return viewer.report_summary(tops, stages.strategies(rows), explain.explanation_rows(rows), gaps).select(
        "run_id", *[shown(column).alias(column) for column in ("recommendations", "evidence", "interview_prep")]
    )


REJOINED_COLUMNS = [
    "jd_index", "variant_ord", "final_overall_score", "assessed", *judge.ASSESSMENT_COLUMNS, "error_type", "error_message",
    "provider", "model", "positive_signals", "dimension_reasons", "evidence_refs",
]


@registered(
    "rejoined",
    sql.query(
        """SELECT jd_id, variant_id, assessed, final_overall_score,
        CASE WHEN NOT assessed THEN split_part(failure, ': ', 1) END AS error_type,
        CASE WHEN NOT assessed THEN split_part(failure, ': ', 2) END AS error_message FROM final"""
    ),
)
def rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Scorecards put together again with their documents, variants, assessments, failures and explanations."""
    documents, people, made = inputs(spark, folder)
    judged = stages.settled(ad.with_judge(stages.scored_pairs(documents, people, made), ad.table(spark, folder, "labels")))
    # What the artifacts read here hold; the texts that pairs were scored by are in none of them.
    rows = durable(judged.select(*stages.PAIR, *REJOINED_COLUMNS))
    cards = rows.select(*stages.PAIR, "jd_index", "variant_ord", "final_overall_score")
    whole = stages.rejoined(cards, documents, people, made, stages.assessments(rows), judge.failure_rows(rows), rows)
    return whole.select("jd_id", "variant_id", "assessed", "final_overall_score", "error_type", "error_message")


@registered(
    "record_defaults",
    """SELECT event_id, 'jd-' || user_id AS jd_id, 'variant-' || event_id AS variant_id, event_type AS stage,
    CASE WHEN event_type = 'error' THEN props ELSE '' END AS raw_output_excerpt FROM events""",
)
def record_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Failure records out of events: required fields are there, a missing optional one takes its default."""
    rows = ad.table(spark, folder, "events").select(
        F.format_string("jd-%d", "user_id").alias("jd_id"),
        F.format_string("variant-%d", "event_id").alias("variant_id"),
        F.col("event_type").alias("stage"),
        F.lit("built-in").alias("provider"),
        F.lit("none").alias("model"),
        F.col("event_type").alias("error_type"),
        F.col("props").alias("error_message"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("raw_output_excerpt"),
        F.col("user_id").alias("jd_index"),
        F.col("event_id").alias("variant_ord"),
    )
    return checked(rows, "llm_failures").select(
        F.col("variant_ord").alias("event_id"), "jd_id", "variant_id", "stage", "raw_output_excerpt"
    )
