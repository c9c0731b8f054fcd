"""Oracle SQL: the queries once more as plain DuckDB SQL over the driver tables.

The SQL is written from the semantics, not from the Spark plans: windows instead of distributed
totals, list functions instead of higher-order expressions.
"""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOT_SPACE = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def blank(x: str) -> str:
    return f"(NOT coalesce(regexp_matches({x}, '{NOT_SPACE}'), false))"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def bullets(x: str) -> str:
    kept = f"list_filter(regexp_split_to_array({x}, '{BREAK}'), lambda l: starts_with({strip('l')}, '-'))"
    inner = "trim(b, '- ')"
    return f"list_transform({kept}, lambda b: {strip(inner)})"


def header(x: str, label: str) -> str:
    line = f"list_filter(regexp_split_to_array({x}, '{BREAK}'), lambda l: starts_with({strip('l')}, '{label}:'))[1]"
    value = f"regexp_extract({line}, '(?s)^[^:]*:(.*)$', 1)"
    return f"coalesce({strip(value)}, '')"


def fmt(x: str) -> str:
    return f"format('{{:.2f}}', CAST({x} AS DOUBLE))"


def r2(x: str) -> str:
    return f"CAST({fmt(x)} AS DOUBLE)"


def bounded(x: str) -> str:
    return r2(f"greatest(0e0, least(0.99e0, {x}))")


def ratio(a: str, n: str) -> str:
    share = bounded(f"CAST({a} AS DOUBLE) / {n}")
    return f"CASE WHEN {n} <= 0 THEN 0e0 ELSE {share} END"


def spaced(*arrays: str) -> str:
    return f"array_to_string(list_concat({', '.join(arrays)}), ' ')" if len(arrays) > 1 else f"array_to_string({arrays[0]}, ' ')"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' | ')"


def none_if_null(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda f: f IS NOT NULL)"


def flat_bullets(x: str) -> str:
    return f"'- ' || replace(replace({x}, chr(10), '. '), '. ', chr(10) || '- ')"


def block(x: str, company: str) -> str:
    return (
        f"'Title: ' || array_to_string(string_split({x}, ' ')[1:3], ' ') || chr(10) || 'Company: ' || {company} "
        f"|| chr(10) || 'Body:' || chr(10) || {flat_bullets(x)}"
    )


def first_token(x: str) -> str:
    return f"regexp_extract({x}, '{NOT_SPACE}+')"


TEXTS = "CAST([] AS VARCHAR[])"


def cluster(title: str, body: str) -> str:
    def slug(x: str) -> str:
        return f"nullif(array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+')[1:4], '-'), '')"

    return f"coalesce({slug(title)}, {slug(spaced(body))}, 'general')"


def found_keywords(lowered: str) -> str:
    hits = f"list_filter(words, lambda w: contains({lowered}, w))"
    return f"CASE WHEN len({hits}) > 0 THEN {hits}[1:5] ELSE ['python', 'ai workflows'] END"


def risk_signals(lowered: str) -> str:
    return none_if_null(
        f"CASE WHEN contains({lowered}, 'metrics') OR contains({lowered}, 'experimentation') "
        "THEN 'Requires metrics storytelling' END",
        f"CASE WHEN contains({lowered}, 'prompt') THEN 'Prompt quality will be probed' END",
    )


def bonus_lines(body: str) -> str:
    lead_gone = "replace(b, 'Bonus for ', '')"
    return f"list_transform(list_filter({body}, lambda l: contains(lower(l), 'bonus')), lambda b: {strip(lead_gone)})"


def missing(items: str, text: str, form=norm) -> str:
    return f"list_filter({items}, lambda k: NOT contains({text}, {form('k')}))"


def lower(x: str) -> str:
    return f"lower({x})"


FINAL = "coalesce(nullif(final_overall_score, 0e0), overall_score)"

MATCHED = (
    "list_filter(list_concat(experiences, projects, skills, verified_evidence), lambda e: len(list_filter(keywords, "
    f"lambda k: contains(lower(e), {first_token('k')}))) > 0)"
)

# The shared chain, in dependency order; every oracle starts with the part it needs.
CHAIN: dict[str, str] = {
    "lex": """SELECT list(word ORDER BY c DESC, word) AS words FROM (
        SELECT word, count(*) AS c FROM (
            SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark)
        WHERE length(word) >= 4 GROUP BY word ORDER BY c DESC, word LIMIT 9)""",
    "cnt": "SELECT count(*) AS n FROM benchmark",
    "jd_raw": f"""SELECT doc_id % n AS run_id, doc_id AS jd_index, 'jd-' || doc_id AS jd_id, words,
        {block('text', 'source')} AS block FROM documents, cnt, lex""",
    "jd_lines": f"""SELECT *, {header('block', 'Title')} AS title, {header('block', 'Company')} AS company,
        {bullets("substr(block, strpos(block, 'Body:') + 5)")} AS responsibilities FROM jd_raw""",
    "jd": f"""SELECT run_id, jd_index, jd_id, title, company, responsibilities,
        {cluster('title', 'responsibilities')} AS cluster, responsibilities[1:2] AS requirements,
        {found_keywords(f"lower({spaced('responsibilities')})")} AS keywords,
        {bonus_lines('responsibilities')} AS bonuses,
        {risk_signals(f"lower({spaced('responsibilities')})")} AS risk_signals FROM jd_lines""",
    "cand_lines": f"""SELECT item_id AS run_id, 'cand-' || item_id AS candidate_id, words,
        'item-' || item_id || '.md' AS base_resume_path, {bullets(flat_bullets('text'))} AS experiences
        FROM benchmark, lex""",
    "cand_parts": f"""SELECT *,
        list_filter(experiences, lambda l: contains(lower(l), 'tion') OR contains(lower(l), 'heit')) AS projects,
        CASE WHEN len(list_filter(words, lambda w: contains(lower({spaced('experiences')}), w))) > 0
             THEN list_filter(words, lambda w: contains(lower({spaced('experiences')}), w))
             ELSE ['AI workflow delivery'] END AS skills,
        CASE WHEN len(experiences) > 0 THEN experiences[1:2] ELSE ['Structured AI workflow delivery'] END AS strengths,
        experiences[1:4] AS verified_evidence FROM cand_lines""",
    "cand": f"""SELECT * EXCLUDE (words),
        {norm(spaced('experiences', 'projects', 'skills', "['AI tooling', 'Resume ops']", 'strengths'))} AS rule_text,
        {norm(spaced('experiences', 'projects', 'skills'))} AS gap_text,
        lower({spaced('experiences', 'projects', 'skills')}) AS claim_text,
        lower({spaced('experiences', 'projects', 'skills', 'strengths')}) AS guard_text FROM cand_parts""",
    "made": f"""SELECT jd.*, cand.* EXCLUDE (run_id), n,
        list_filter(list_transform(keywords, lambda k: list_filter(list_concat(experiences, skills),
            lambda l: contains(lower(l), {first_token('k')}))[1]), lambda m: m IS NOT NULL) AS matched,
        {missing('keywords', 'claim_text', lower)} AS unclaimed
        FROM jd JOIN cand USING (run_id), cnt""",
    "variant": """SELECT run_id, jd_index * 2 AS variant_ord, 'variant-jd-' || jd_id AS variant_id,
        'jd-specific' AS variant_type, [jd_id] AS target_jd_ids,
        title || ' variant focused on ' || coalesce(strengths[1], 'cross-functional execution') || ', '
            || keywords[1] || ', and evidence-backed delivery.' AS summary,
        CASE WHEN len(matched) > 0 THEN matched[1:3] ELSE strengths[1:2] END AS emphasized_strengths,
        CASE WHEN len(unclaimed) > 0 THEN unclaimed[1:3] ELSE [keywords[-1]] END AS stretch_points FROM made
        UNION ALL
        SELECT run_id, jd_index * 2 + 1, 'variant-cluster-' || jd_id, 'cluster', [jd_id, 'jd-' || (jd_index + n)],
        cluster || ' cluster resume emphasizing ' || coalesce(strengths[1], 'AI workflow delivery')
            || ' across 2 related roles.',
        list_concat(requirements, strengths)[1:2], list_concat(keywords[1:2], requirements)[1:3] FROM made""",
    "target": """SELECT * EXCLUDE (target_jd_ids), unnest(list_distinct(target_jd_ids)) AS jd_id FROM variant""",
    "pair": f"""SELECT jd.*, target.* EXCLUDE (run_id, jd_id), cand.* EXCLUDE (run_id),
        {norm(spaced('[summary]', 'emphasized_strengths', 'stretch_points'))} AS variant_text,
        {norm(spaced('responsibilities', 'requirements', 'keywords', 'bonuses'))} AS jd_text
        FROM jd JOIN target USING (run_id, jd_id) JOIN cand USING (run_id)""",
    "hits": f"""SELECT *,
        list_filter(keywords, lambda k: contains(variant_text, {norm('k')}) OR contains(rule_text, {norm('k')}))
            AS keyword_hits,
        list_filter(emphasized_strengths, lambda s: contains(rule_text, {norm('s')})) AS bound,
        list_filter(stretch_points, lambda p: NOT contains(rule_text, {norm('p')})
            AND NOT contains(jd_text, {norm('p')})) AS untraceable,
        {missing('keywords', 'gap_text')} AS lacking FROM pair""",
    "shares": f"""SELECT *, {ratio('len(keyword_hits)', 'len(keywords)')} AS kc,
        {ratio('len(bound)', 'len(emphasized_strengths)')} AS eb,
        {ratio('len(untraceable)', 'greatest(1, len(stretch_points))')} AS fr,
        CASE WHEN variant_type = 'cluster' THEN 0.28e0 ELSE 0.42e0 END AS distance,
        CASE WHEN variant_type = 'cluster' THEN 0.85e0 ELSE 0.55e0 END AS reuse FROM hits""",
    "parts": f"""SELECT *, {bounded('kc * 0.6e0 + eb * 0.4e0')} AS fit_score, {bounded('kc')} AS ats_score,
        {bounded('eb')} AS evidence_score, {bounded('greatest(0.1e0, 0.9e0 - fr)')} AS stretch_score,
        {bounded('least(0.95e0, (1 - kc) * 0.45e0 + (1 - eb) * 0.35e0 + fr * 0.2e0)')} AS gap_risk_score,
        {bounded('1 - reuse + distance * 0.15e0')} AS rewrite_cost_score FROM shares""",
    "rule": f"""SELECT *, {bounded('fit_score * 0.32e0 + ats_score * 0.16e0 + evidence_score * 0.2e0'
        ' + stretch_score * 0.1e0 + (1 - gap_risk_score) * 0.17e0 + (1 - rewrite_cost_score) * 0.05e0')}
        AS overall_score,
        CASE WHEN len(lacking) > 0 THEN 1 ELSE 0 END AS gap_count,
        'Confidently discuss ' || array_to_string(lacking[1:2], ', ') AS target_state,
        CASE WHEN len(lacking) >= 2 THEN 'high' ELSE 'medium' END AS priority,
        list_transform(lacking[1:2], lambda k: 'Evidence for ' || k || ' is currently indirect.') AS weak_points
        FROM parts""",
    "fits": f"""SELECT *, {r2('least(0.99e0, greatest(0e0, overall_score + 0.03e0))')} AS role_fit,
        CASE WHEN len(verified_evidence) > 0 THEN 0.8e0 ELSE 0.62e0 END AS evidence_quality,
        CASE WHEN variant_type = 'jd-specific' THEN 0.76e0 ELSE 0.68e0 END AS persuasiveness FROM rule""",
    "assess": f"""SELECT *, {r2('greatest(0e0, 1 - role_fit)')} AS risk,
        CASE WHEN role_fit >= 0.8e0 THEN 'strong_apply' WHEN role_fit >= 0.65e0 THEN 'apply' ELSE 'hold' END AS worth,
        'Deterministic LLM-assessment fallback based on rule score ' || {fmt('overall_score')} || '.' AS said
        FROM fits""",
    "outcome": """SELECT assess.* EXCLUDE (worth, said), worth AS first_worth, quality, toxic,
        CASE WHEN quality = 0 AND toxic = 1 THEN ' ' ELSE worth END AS worth,
        CASE WHEN toxic = 1 THEN '' ELSE said END AS said,
        CASE WHEN quality = 0 THEN CAST([] AS VARCHAR[]) ELSE verified_evidence[1:3] END AS cited,
        quality IS NOT NULL AND NOT (quality = 0 AND toxic = 1) AS assessed,
        CASE WHEN quality IS NULL THEN 'LookupError: no label for ' || assess.jd_id
             WHEN quality = 0 AND toxic = 1 THEN 'ValueError: assessment payload missing core fields' END AS failure
        FROM assess LEFT JOIN labels ON labels.doc_id = assess.jd_index""",
    "flagged": f"""SELECT *, CASE WHEN assessed THEN {none_if_null(
        f"CASE WHEN {blank('said')} OR len(cited) = 0 THEN 'llm_assessment_incomplete' END",
        "CASE WHEN eb < 0.4e0 THEN 'insufficient_evidence_cap' END",
        "CASE WHEN len(untraceable) > 0 THEN 'untraceable_claims' END",
        "CASE WHEN worth = 'strong_apply' AND len(list_filter(requirements, "
        "lambda m: NOT contains(guard_text, lower(m)))) > 0 THEN 'missing_must_have_requirements' END",
    )} ELSE ['llm_assessment_missing'] END AS flags,
        CASE WHEN assessed THEN {r2('role_fit * 0.35e0 + evidence_quality * 0.25e0 + persuasiveness * 0.2e0'
        ' + (1 - risk) * 0.2e0')} ELSE 0e0 END AS llm_overall FROM outcome""",
    "final": f"""SELECT *, CASE WHEN NOT assessed THEN overall_score ELSE {r2(
        "least(llm_overall, CASE WHEN list_contains(flags, 'insufficient_evidence_cap') THEN 0.65e0 ELSE 9e0 END, "
        "CASE WHEN list_contains(flags, 'missing_must_have_requirements') THEN 0.79e0 ELSE 9e0 END)"
    )} END AS final_overall_score,
        CASE WHEN NOT assessed THEN 'guardrail-fallback' WHEN len(flags) > 0 THEN 'llm-primary+guardrail'
             ELSE 'llm-primary' END AS source FROM flagged""",
    "told": f"""SELECT *, CASE WHEN assessed AND said <> '' THEN said
        WHEN assessed THEN 'LLM assessment accepted with incomplete rationale; final score ' || {fmt(FINAL)} || '.'
        ELSE 'LLM assessment unavailable: ' || failure || '. Fallback to rules with overall score '
            || {fmt('overall_score')} || '.' END AS told FROM final""",
    "expl": f"""SELECT *, 'rule_fit=' || {fmt('fit_score')} || '; llm_role_fit='
            || {fmt('CASE WHEN assessed THEN role_fit ELSE 0e0 END')} AS reason_fit,
        'rule_evidence=' || {fmt('eb')} || '; llm_evidence='
            || {fmt('CASE WHEN assessed THEN evidence_quality ELSE 0e0 END')} AS reason_evidence,
        ['final_score=' || {fmt(FINAL)}, 'decision_source=' || source] AS signals,
        CASE WHEN len(flags) > 0 THEN flags ELSE untraceable[1:2] END AS risk_flags,
        CASE WHEN assessed AND len(cited) > 0 THEN cited ELSE {MATCHED}[1:3] END AS refs FROM told""",
    "ordered": f"""SELECT *, row_number() OVER (PARTITION BY run_id, jd_id ORDER BY {FINAL} DESC, fit_score DESC,
        evidence_score DESC, gap_risk_score, jd_index, variant_ord) AS place FROM expl""",
    "ranked": f"""SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {FINAL} DESC, fit_score DESC,
        evidence_score DESC, gap_risk_score, jd_index) AS priority_rank FROM ordered WHERE place = 1""",
    "strat": f"""SELECT *, CASE WHEN {FINAL} >= 0.7e0 THEN 'apply' ELSE 'hold' END AS apply_decision,
        {r2(f'least(0.95e0, greatest(0.35e0, {FINAL} + 0.1e0))')} AS confidence,
        CASE WHEN assessed THEN said ELSE 'LLM assessment unavailable: ' || failure END AS reason_summary,
        ['Final score ' || {fmt(FINAL)}, 'Variant type: ' || variant_type] AS drivers,
        CASE WHEN len(flags) > 0 THEN flags ELSE ['Large-scale online experiment ownership'] END AS watchouts,
        CASE WHEN NOT assessed THEN ['Refine core evidence bullets.']
             WHEN len(stretch_points) > 0 THEN stretch_points[1:2]
             ELSE ['Refine 2-3 evidence-backed bullets before applying.'] END AS actions,
        CASE WHEN assessed AND first_worth = 'hold' THEN ['Core evidence is too weak for this role level.']
             ELSE {TEXTS} END AS tasks FROM ranked""",
    "summary": f"""SELECT run_id, jd_index, max_by(jd_id, k) AS jd_id, max_by(title, k) AS title,
        max_by(variant_id, k) AS variant_id, max_by(signals, k) AS reasons, max_by(gap_count, g) AS gap_count,
        max_by(lacking, g) AS lacking, max_by(weak_points, g) AS weak_points,
        max_by(final_overall_score, k) AS score
        FROM (SELECT *, ROW({FINAL}, fit_score, evidence_score, -gap_risk_score, -variant_ord) AS k,
                     ROW(overall_score, -variant_ord) AS g FROM expl) GROUP BY run_id, jd_index""",
    "event_card": """SELECT event_type AS run_id, user_id AS jd_index, event_id AS variant_ord,
        CAST(CAST(floor(value * 100) AS BIGINT) % 7 AS DOUBLE) / 100 AS final_overall_score,
        CAST(CAST(floor(value * 100) AS BIGINT) % 11 AS DOUBLE) / 100 AS overall_score,
        CAST(CAST(floor(value * 100) AS BIGINT) % 3 AS DOUBLE) / 100 AS fit_score,
        CAST(CAST(floor(value * 100) AS BIGINT) % 5 AS DOUBLE) / 100 AS evidence_score,
        CAST(CAST(floor(value * 100) AS BIGINT) % 4 AS DOUBLE) / 100 AS gap_risk_score FROM events""",
    "event_best": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, jd_index
        ORDER BY {FINAL} DESC, fit_score DESC, evidence_score DESC, gap_risk_score, variant_ord) AS place
        FROM event_card) WHERE place = 1""",
    "listing": """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS run_id, page_id,
        CASE page_id % 11 WHEN 0 THEN 'ingest/manifest.json' WHEN 1 THEN 'analyze/candidate_profile.json'
            WHEN 2 THEN 'analyze/jd_profiles.json' WHEN 3 THEN 'generate/resume_variants.json'
            WHEN 4 THEN 'evaluate/scorecards.json' WHEN 5 THEN 'evaluate/gap_maps.json'
            WHEN 6 THEN 'evaluate/eval_summary.json' WHEN 7 THEN 'plan/application_strategies.json'
            WHEN 8 THEN 'report/summary.md' WHEN 9 THEN 'ingest/upload_manifest.json' ELSE url END AS artifact
        FROM pages""",
    "stages": f"""SELECT run_id, list_has_any(list(artifact), ['ingest/upload_manifest.json']) AS has_draft,
        {none_if_null(
            "CASE WHEN list_has_all(list(artifact), ['ingest/manifest.json']) THEN 'ingest' END",
            "CASE WHEN list_has_all(list(artifact), ['analyze/candidate_profile.json', 'analyze/jd_profiles.json']) "
            "THEN 'analyze' END",
            "CASE WHEN list_has_all(list(artifact), ['generate/resume_variants.json']) THEN 'generate' END",
            "CASE WHEN list_has_all(list(artifact), ['evaluate/scorecards.json', 'evaluate/gap_maps.json', "
            "'evaluate/eval_summary.json']) THEN 'evaluate' END",
            "CASE WHEN list_has_all(list(artifact), ['plan/application_strategies.json']) THEN 'plan' END",
            "CASE WHEN list_has_all(list(artifact), ['report/summary.md']) THEN 'report' END",
        )} AS done FROM listing GROUP BY run_id""",
}


def query(select: str) -> str:
    """``select`` behind the whole chain; DuckDB leaves out what a query does not use."""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in CHAIN.items()) + "\n" + select
