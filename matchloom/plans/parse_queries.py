"""Parsing and profile queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators import candidate as cand
from matchloom.operators import parse
from matchloom.plans import adapters as ad
from matchloom.plans import oracle as sql
from matchloom.plans.registry import registered


def shown(array: str | Column) -> Column:
    return F.array_join(array, " | ")


@registered(
    "parse_jd_blocks",
    sql.query(
        f"""SELECT lang AS run_id, doc_id AS input_ord,
        'jd-' || lpad(CAST(no AS VARCHAR), CAST(greatest(3, length(CAST(no AS VARCHAR))) AS INTEGER), '0') AS jd_id,
        no - 1 AS jd_index, length(block) AS block_chars, md5(block) AS block_md5
        FROM (SELECT lang, doc_id, block, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS no
              FROM (SELECT lang, doc_id, pos, {sql.strip(f"{sql.block('line', 'source')}")} AS block
                    FROM (SELECT lang, source, doc_id, unnest(string_split(text, chr(10))) AS line,
                                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)))"""
    ),
)
def parse_jd_blocks(spark: SparkSession, folder: str) -> DataFrame:
    numbered = parse.number_blocks(ad.jd_inputs(spark, folder))
    return numbered.select(
        "run_id",
        "input_ord",
        "jd_id",
        "jd_index",
        F.length("block").cast("long").alias("block_chars"),
        F.md5(F.encode("block", "UTF-8")).alias("block_md5"),
    )


@registered("jd_headers", sql.query("SELECT jd_id, title, company FROM jd"))
def jd_headers(spark: SparkSession, folder: str) -> DataFrame:
    block = F.col("block")
    return ad.jd_blocks(spark, folder).select(
        "jd_id", tx.header(block, "Title").alias("title"), tx.header(block, "Company").alias("company")
    )


@registered(
    "jd_body_lines",
    sql.query(
        "SELECT jd_id, len(responsibilities) AS n_lines, md5(array_to_string(responsibilities, chr(10))) AS lines_md5 "
        "FROM jd"
    ),
)
def jd_body_lines(spark: SparkSession, folder: str) -> DataFrame:
    body = ad.jd_blocks(spark, folder).select("jd_id", tx.body_bullets(F.col("block")).alias("body"))
    return body.select(
        "jd_id",
        F.size("body").cast("long").alias("n_lines"),
        F.md5(F.encode(F.array_join("body", "\n"), "UTF-8")).alias("lines_md5"),
    )


@registered(
    "resume_bullets",
    f"""SELECT conv_id, turn, len(b) AS n_bullets, md5(array_to_string(b, chr(10))) AS bullets_md5
    FROM (SELECT conv_id, turn, {sql.bullets(sql.flat_bullets('text'))} AS b FROM conversations)""",
)
def resume_bullets(spark: SparkSession, folder: str) -> DataFrame:
    found = ad.cv_documents(spark, folder).withColumn("b", tx.bullets(F.col("text")))
    return found.select(
        F.col("run_id").alias("conv_id"),
        F.col("input_ord").alias("turn"),
        F.size("b").cast("long").alias("n_bullets"),
        F.md5(F.encode(F.array_join("b", "\n"), "UTF-8")).alias("bullets_md5"),
    )


@registered(
    "join_cv_text",
    f"""SELECT conv_id, turn, CAST(sum(length(piece) + 2) OVER (PARTITION BY conv_id ORDER BY turn)
        - length(piece) - 2 AS BIGINT) AS start_char, piece
    FROM (SELECT conv_id, turn, 'Source: conv-' || conv_id || '/turn-' || turn || '.md' || chr(10)
                 || {sql.strip(f"({sql.flat_bullets('text')})")} AS piece FROM conversations)""",
)
def join_cv_text(spark: SparkSession, folder: str) -> DataFrame:
    pieces = cand.text_pieces(ad.cv_documents(spark, folder))
    return pieces.select(
        F.col("run_id").alias("conv_id"),
        F.col("input_ord").alias("turn"),
        F.col("start_char").cast("long").alias("start_char"),
        "piece",
    )


@registered(
    "candidate_profile",
    sql.query(
        f"""SELECT candidate_id, base_resume_path, len(experiences) AS n_experiences, {sql.joined('projects')} AS projects,
        {sql.joined('skills')} AS skills, {sql.joined('strengths')} AS strengths,
        {sql.joined('experiences[1:3]')} AS core_claims, {sql.joined('verified_evidence')} AS verified_evidence FROM cand"""
    ),
)
def candidate_profile(spark: SparkSession, folder: str) -> DataFrame:
    return ad.candidates(spark, folder).select(
        "candidate_id",
        "base_resume_path",
        F.size("experiences").cast("long").alias("n_experiences"),
        shown("projects").alias("projects"),
        shown("skills").alias("skills"),
        shown("strengths").alias("strengths"),
        shown("core_claims").alias("core_claims"),
        shown("verified_evidence").alias("verified_evidence"),
    )


@registered(
    "jd_profile",
    sql.query(
        f"""SELECT run_id, jd_id, title, company, cluster, len(responsibilities) AS n_responsibilities,
        {sql.joined('requirements')} AS requirements, {sql.joined('keywords')} AS keywords, 'mid' AS seniority,
        {sql.joined('keywords[1:3]')} AS interview_focus_areas, 0.72e0 AS role_level_confidence FROM jd"""
    ),
)
def jd_profile(spark: SparkSession, folder: str) -> DataFrame:
    return ad.jd_profiles(spark, folder).select(
        "run_id",
        "jd_id",
        "title",
        "company",
        "cluster",
        F.size("responsibilities").cast("long").alias("n_responsibilities"),
        shown("requirements").alias("requirements"),
        shown("keywords").alias("keywords"),
        "seniority",
        shown("interview_focus_areas").alias("interview_focus_areas"),
        "role_level_confidence",
    )


@registered("jd_keywords", sql.query(f"SELECT jd_id, {sql.joined('keywords')} AS keywords FROM jd"))
def jd_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return ad.jd_profiles(spark, folder).select("jd_id", shown("keywords").alias("keywords"))


@registered(
    "jd_fixed_keywords",
    f"""SELECT doc_id, CASE WHEN len(f) > 0 THEN {sql.joined('f[1:5]')} ELSE 'python | ai workflows' END AS keywords
    FROM (SELECT doc_id, {sql.none_if_null(*[
        f"CASE WHEN contains(t, '{needle}') THEN '{label}' END" for needle, label in parse.KEYWORD_LEXICON])} AS f
        FROM (SELECT doc_id, lower(replace(replace(replace(text, 'the', 'ranking'), 'tion', 'metrics'), 'ou', 'llm'))
              AS t FROM documents))""",
)
def jd_fixed_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The built-in lexicon; a few frequent syllables stand in for its words, as the tables hold none."""
    text = F.col("text")
    for syllable, word in (("the", "ranking"), ("tion", "metrics"), ("ou", "llm")):
        text = F.replace(text, F.lit(syllable), F.lit(word))
    return ad.documents(spark, folder).select(
        "doc_id", shown(parse.keywords(F.lower(text))).alias("keywords")
    )


@registered(
    "jd_bonuses",
    f"""SELECT doc_id, len(b) AS n_bonuses, {sql.joined('b[1:2]')} AS nice_to_have, md5({sql.joined('b')}) AS bonuses_md5
    FROM (SELECT doc_id, {sql.bonus_lines(sql.bullets(sql.flat_bullets("replace(text, 'The ', 'Bonus for ')")))} AS b
          FROM documents)""",
)
def jd_bonuses(spark: SparkSession, folder: str) -> DataFrame:
    """Bonus lines; sentences that open with an article stand in for them."""
    text = F.replace(F.col("text"), F.lit("The "), F.lit("Bonus for "))
    found = ad.documents(spark, folder).select(
        "doc_id", parse.bonuses(tx.bullets(ad.as_bullets(text))).alias("b")
    )
    return found.select(
        "doc_id",
        F.size("b").cast("long").alias("n_bonuses"),
        shown(tx.head(F.col("b"), 2)).alias("nice_to_have"),
        F.md5(F.encode(shown("b"), "UTF-8")).alias("bonuses_md5"),
    )


@registered("jd_cluster", sql.query("SELECT jd_id, cluster FROM jd"))
def jd_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return ad.jd_profiles(spark, folder).select("jd_id", "cluster")


RISK_TEXT = "replace(replace(text, 'erth', 'metrics'), 'onth', 'prompt')"


@registered(
    "risk_signals",
    f"""SELECT doc_id, {sql.joined('s')} AS risk_signals,
    {sql.joined("list_filter(s, lambda x: contains(lower(x), 'metrics'))")} AS hidden_signals
    FROM (SELECT doc_id, {sql.risk_signals(f'lower({RISK_TEXT})')} AS s FROM documents)""",
)
def risk_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Risk signals; two syllables stand in for the words that raise them."""
    text = F.replace(F.replace("text", F.lit("erth"), F.lit("metrics")), F.lit("onth"), F.lit("prompt"))
    found = ad.documents(spark, folder).select(
        "doc_id", parse.risk_signals(F.lower(text)).alias("signals")
    )
    hidden = F.filter("signals", lambda signal: F.contains(F.lower(signal), F.lit("metrics")))
    return found.select("doc_id", shown("signals").alias("risk_signals"), shown(hidden).alias("hidden_signals"))


@registered(
    "evidence_map",
    sql.query(
        f"""SELECT run_id, jd_id, {sql.joined('requirements')} AS must_have,
        {sql.joined('responsibilities[1:3]')} AS source_snippets, {sql.joined('risk_signals')} AS risk_signals,
        {sql.joined('experiences[1:3]')} AS core_claims, {sql.joined('verified_evidence')} AS verified_evidence,
        'Large-scale online experiment ownership' AS risks
        FROM jd JOIN cand USING (run_id)"""
    ),
)
def evidence_map(spark: SparkSession, folder: str) -> DataFrame:
    documents = parse.jd_evidence(ad.jd_profiles(spark, folder))
    people = ad.candidates(spark, folder).select(
        "run_id", "core_claims", "verified_evidence", F.col("missing_evidence_areas").alias("risks")
    )
    return documents.join(people, "run_id").select(
        "run_id",
        "jd_id",
        *[
            shown(column).alias(column)
            for column in ("must_have", "source_snippets", "risk_signals", "core_claims", "verified_evidence", "risks")
        ],
    )


@registered("normalize_text", f"SELECT doc_id, {sql.norm('text')} AS normalised FROM documents")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return ad.documents(spark, folder).select("doc_id", tx.normalised(F.col("text")).alias("normalised"))


PROPS_SCORE = "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50"


@registered(
    "safe_score",
    f"""SELECT event_id, CASE WHEN k IS NULL THEN 0e0 ELSE {sql.r2('greatest(0e0, least(1e0, k))')} END AS score,
    CASE WHEN t IS NULL THEN 0e0 ELSE {sql.r2('greatest(0e0, least(1e0, t))')} END AS unreadable,
    CASE WHEN k IS NULL THEN 0e0 ELSE {sql.r2('greatest(0e0, least(1e0, k))')} END AS padded, 0e0 AS suffixed
    FROM (SELECT event_id, {PROPS_SCORE} AS k, TRY_CAST(event_type AS DOUBLE) AS t FROM events)""",
)
def safe_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores out of JSON text: in range, above it, and not a number at all."""
    raw = F.get_json_object("props", "$.k").try_cast("double") / 50
    return ad.table(spark, folder, "events").select(
        "event_id",
        sc.safe_score(raw.cast("string")).alias("score"),
        sc.safe_score(F.col("event_type")).alias("unreadable"),
        sc.safe_score(F.concat(F.lit("\t"), raw.cast("string"), F.lit("\u3000"))).alias("padded"),
        sc.safe_score(F.concat(raw.cast("string"), F.lit("d"))).alias("suffixed"),
    )


@registered(
    "safe_list",
    """SELECT event_id, array_to_string(list_filter([json_extract_string(props, '$.k'), json_extract_string(props, '$.k') || '.0', event_type,
        CASE WHEN value > 10 THEN 'True' ELSE 'False' END, 'None'], lambda x: x IS NOT NULL), ' | ') AS items,
    0::BIGINT AS not_a_list FROM events""",
)
def safe_list(spark: SparkSession, folder: str) -> DataFrame:
    """Lists out of JSON text with numbers, texts, blanks, booleans and nulls in them."""
    payload = F.concat(
        F.lit("["), F.get_json_object("props", "$.k"), F.lit(", "), F.get_json_object("props", "$.k"),
        F.lit('.0, "'), "event_type", F.lit('", " ", "\\t", "\u3000", '),
        F.when(F.col("value") > 10, "true").otherwise("false"), F.lit(", null]"),
    )
    return ad.table(spark, folder, "events").select(
        "event_id",
        shown(sc.safe_texts(payload)).alias("items"),
        F.size(sc.safe_texts(F.col("props"))).cast("long").alias("not_a_list"),
    )
