"""One run on disk, stage by stage: each reads the artifacts of the earlier ones and writes its own."""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import config as cfg
from matchloom.operators import candidate as cand
from matchloom.operators import evidence_map, explain, judge, parse, ranking, remote, replies, report, strategy, variants
from matchloom.plans import stages
from matchloom.session import durable
from matchloom.sources import files, uploads
from matchloom.sources.artifacts import FILE, FOLDER, write_artifact
from matchloom.sources.paths import absolute, kind, literal, opens_in_tasks
from matchloom.sources.records import read_records, write_json, write_records

RUN = "run"
KEEP_NULLS = {"ignoreNullFields": "false"}

Progress = Callable[[dict[str, Any]], None]
#: How a run keeps its artifacts by default: a file each, as other tools expect them.
FORM = FILE


def artifact(run_dir: str, stage: str, name: str) -> str:
    return os.path.join(run_dir, stage, f"{name}.json")


def read(spark: SparkSession, run_dir: str, stage: str, table: str, optional_file: bool = False) -> DataFrame:
    return read_records(spark, artifact(run_dir, stage, table), table, RUN, optional_file)


def variants_of(spark: SparkSession, run_dir: str) -> DataFrame:
    return read(spark, run_dir, "generate", "resume_variants").withColumnRenamed("cluster", "variant_cluster")


def optional_tools(settings: cfg.ExtractionSettings, transport: remote.Transport) -> files.Extractors:
    """Readers for PDF and images, as far as their packages are installed."""
    tools = files.Extractors(
        ocr_provider=settings.ocr_provider,
        ocr_languages=settings.ocr_languages,
        vision_provider=settings.vision_provider,
        vision=remote.vision_reader(settings.vision, transport) if settings.vision else None,
    )
    try:
        import pypdf

        def pages(data: bytes) -> str:
            import io

            return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)

        tools = replace(tools, pdf=pages)
    except ImportError:
        pass
    try:
        import pytesseract
        from PIL import Image

        def ocr(data: bytes, languages: str) -> str:
            import io

            with Image.open(io.BytesIO(data)) as image:
                return str(pytesseract.image_to_string(image, lang=languages))

        tools = replace(tools, ocr=ocr)
    except ImportError:
        pass
    return tools


def ingest(
    spark: SparkSession,
    run_dir: str,
    candidate_id: str,
    cv_sources: list[str],
    jd_sources: list[str],
    config_path: str | None = None,
    vision_fallback: bool | None = None,
    ocr_languages: str | None = None,
    extractors: files.Extractors | None = None,
    transport: remote.Transport = remote.post_json,
    form: str = FORM,
) -> str:
    cfg.write_config(run_dir, config_path, vision_fallback, ocr_languages)
    settings = cfg.extraction_settings(cfg.load_config(run_dir), run_dir, vision_fallback, ocr_languages)
    tools = extractors or optional_tools(settings, transport)
    uploaded = uploads.read_upload_items(spark, run_dir, RUN)
    tables: dict[str, DataFrame] = {}
    for role, label, sources in (("cv", "CV", cv_sources), ("jd", "JD", jd_sources)):
        if not sources:
            raise ValueError(f"At least one {label} input is required for ingest.")
        # Extraction may call out to OCR or a paid service, so it runs once.
        documents = durable(files.collect_documents(spark, sources, RUN, tools))
        files.require_text(documents, label)
        tables[role] = uploads.manifest_items(documents, uploaded, role, run_dir)
    for role, name in (("cv", "candidate_inputs"), ("jd", "jd_inputs")):
        tables[role] = durable(tables[role])
        write_artifact(tables[role].drop("run_id"), F.to_json(F.struct("*"), KEEP_NULLS), ["input_ord"], artifact(run_dir, "ingest", name))
    warnings = [uploads.input_warnings(tables[role]) for role in ("cv", "jd")]
    # Candidate inputs come first, as in the manifest.
    placed = reduce(DataFrame.unionByName, [rows.withColumn("_list", F.lit(i)) for i, rows in enumerate(warnings)])
    order = ["_list", "input_ord"]
    value = F.to_json(F.struct(*[c for c in placed.columns if c not in ("_list", "run_id")]), KEEP_NULLS)
    write_artifact(placed, value, order, artifact(run_dir, "ingest", "input_warnings"))
    return write_manifest(run_dir, candidate_id, tables["cv"], tables["jd"], warnings, form)


def listed(name: str, lists: list[DataFrame], step: int, last: bool) -> DataFrame:
    """Pieces of a JSON list (step, part, place, piece) of the rows of several tables, one after the other."""
    spark = lists[0].sparkSession
    edge = lambda part, piece: spark.range(1).select(
        F.lit(step).alias("step"), F.lit(part).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(piece).alias("piece")
    )
    out = edge(-1, f"{json.dumps(name)}: [").unionByName(edge(len(lists), "]" if last else "],\n"))
    # Every item ends with a comma but the last one of all.
    ends = [rows.agg(F.max("input_ord")).head()[0] for rows in lists]
    final = max((i for i, end in enumerate(ends) if end is not None), default=None)
    for i, rows in enumerate(lists):
        text = F.to_json(F.struct(*[c for c in rows.columns if c not in ("run_id", "input_ord")]), KEEP_NULLS)
        comma = F.lit(",\n") if i != final else F.when(F.col("input_ord") == ends[i], F.lit("\n")).otherwise(F.lit(",\n"))
        out = out.unionByName(
            rows.select(F.lit(step).alias("step"), F.lit(i).alias("part"), F.col("input_ord").alias("place"), F.concat(text, comma).alias("piece"))
        )
    return out


def resume_pieces(cvs: DataFrame, step: int) -> DataFrame:
    """Pieces of the candidate text as one JSON string."""
    spark, quoted = cvs.sparkSession, F.to_json(F.array("piece"))
    inside = F.substring(quoted, F.lit(3), F.length(quoted) - 4)
    texts = cand.text_pieces(cvs).select(
        F.lit(step).alias("step"), F.lit(0).alias("part"), F.col("input_ord").alias("place"),
        F.concat(F.when(F.col("start_char") > 0, F.lit("\\n\\n")).otherwise(F.lit("")), inside).alias("piece"),
    )
    edge = lambda part, piece: spark.range(1).select(
        F.lit(step).alias("step"), F.lit(part).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(piece).alias("piece")
    )
    return texts.unionByName(edge(-1, '"candidate_resume_text": "')).unionByName(edge(1, '",\n'))


def write_manifest(
    run_dir: str, candidate_id: str, cvs: DataFrame, jds: DataFrame, warnings: list[DataFrame], form: str = FORM
) -> str:
    """Manifest of the run. As a file for other tools it repeats inputs, texts and warnings, however many; of a
    run in folders these have their tables only."""
    first = cvs.agg(F.min_by("source_value", "input_ord").alias("path")).head()["path"]
    head = {"candidate_id": candidate_id, "candidate_resume_path": first}
    path = artifact(run_dir, "ingest", "manifest")
    if form == FOLDER:
        return write_json(path, head)
    pieces = (
        resume_pieces(cvs, 0)
        .unionByName(listed("candidate_inputs", [cvs], 1, False))
        .unionByName(listed("jd_inputs", [jds.withColumn("content", F.col("text"))], 2, False))
        .unionByName(listed("input_warnings", warnings, 3, True))
    )
    opening = json.dumps(head, ensure_ascii=False).removesuffix("}") + ",\n"
    return write_artifact(pieces, F.col("piece"), ["step", "part", "place"], path, FILE, opening, "", "}\n")


def read_inputs(spark: SparkSession, run_dir: str, name: str) -> DataFrame:
    """Ingested inputs, from their table or, for runs of other tools, from the manifest itself."""
    table = artifact(run_dir, "ingest", name)
    if kind(table) == FOLDER:
        return read_records(spark, table, "input_documents", RUN)
    item = "STRUCT<source_type: STRING, source_value: STRING, text: STRING, content: STRING>"
    manifest = spark.read.schema(f"{name} ARRAY<{item}>").option("multiLine", "true").json(
        literal(absolute(artifact(run_dir, "ingest", "manifest")))
    )
    return manifest.select(F.lit(RUN).alias("run_id"), F.posexplode(name).alias("input_ord", "item")).select(
        "run_id", F.col("input_ord").cast("long").alias("input_ord"), "item.source_type", "item.source_value",
        F.coalesce("item.text", "item.content").alias("text"),
    )


def reply_log(run_dir: str, stage: str) -> str:
    """Where a stage logs remote replies; the same stage, run again, asks for what is missing there."""
    return os.path.join(run_dir, stage, "replies")


def analyze(
    spark: SparkSession, run_dir: str, transport: remote.Transport = remote.post_json, form: str = FORM
) -> dict[str, Any]:
    settings = cfg.load_config(run_dir)
    endpoint = cfg.endpoint(settings, "analyzer", "analyze", run_dir)
    head = manifest_head(spark, run_dir)
    cvs, inputs = read_inputs(spark, run_dir, "candidate_inputs"), read_inputs(spark, run_dir, "jd_inputs")
    resumes = cand.experiences(cvs).select(
        "run_id",
        F.lit(head["candidate_id"]).alias("candidate_id"),
        F.lit(head["candidate_resume_path"]).alias("base_resume_path"),
        "experiences",
    )
    blocks = parse.number_blocks(
        inputs.select("run_id", "input_ord", "source_type", "source_value", F.col("text").alias("content"))
    )
    people, documents, evidence = cand.candidate_profiles(resumes), parse.jd_profiles(blocks), None
    if endpoint is not None:
        log = reply_log(run_dir, "analyze")
        resumes = resumes.join(cand.joined_text(cvs), "run_id")
        people, documents, evidence = remote_profiles(resumes, inputs, people, documents, endpoint, transport, log)
    write_records(people, artifact(run_dir, "analyze", "candidate_profile"), "candidate_profile", single=True, form=form)
    write_records(documents, artifact(run_dir, "analyze", "jd_profiles"), "jd_profiles", form=form)
    people, documents = read(spark, run_dir, "analyze", "candidate_profile"), read(spark, run_dir, "analyze", "jd_profiles")
    count = documents.count()
    rows = evidence_map.made(people, documents) if evidence is None else evidence(people, documents)
    write_evidence(rows, artifact(run_dir, "analyze", "evidence_map"), form)
    return {"candidate_id": head["candidate_id"], "jd_profiles": count}


def manifest_head(spark: SparkSession, run_dir: str) -> dict[str, str]:
    """Candidate and first path of the manifest; its lists are not read."""
    path = artifact(run_dir, "ingest", "manifest")
    if kind(path) is None:
        raise FileNotFoundError(path)
    fields = "candidate_id STRING, candidate_resume_path STRING"
    return spark.read.schema(fields).option("multiLine", "true").json(literal(absolute(path))).head().asDict()


def remote_profiles(
    resumes: DataFrame,
    inputs: DataFrame,
    people: DataFrame,
    documents: DataFrame,
    endpoint: cfg.Endpoint,
    transport: remote.Transport,
    log: str | None = None,
) -> tuple[DataFrame, DataFrame, Callable[[DataFrame, DataFrame], DataFrame]]:
    """Profiles and evidence from the remote analyzer, and the built-in ones for runs it failed for.

    The evidence is a function of the final profiles, from which the built-in map is made.

    One request carries a whole run, so its documents are put into one text, as the resume is.
    """
    item = F.struct("source_type", "source_value", F.col("text").alias("content"))
    sorted_items = F.array_sort(F.collect_list(F.struct("input_ord", item.alias("item"))))
    as_json = inputs.groupBy("run_id").agg(
        F.to_json(F.transform(sorted_items, lambda entry: entry["item"])).alias("jd_json")
    )
    answers = durable(remote.ask_analyzer(resumes, as_json, endpoint, transport, log))
    answered_people = remote.analyzed_candidates(answers, resumes)
    answered_documents = remote.analyzed_jds(answers)
    good = (
        answered_people.filter(F.size("experiences") > 0)
        .select("run_id")
        .join(answered_documents.select("run_id").distinct(), "run_id", "left_semi")
    )

    def merged(answered: DataFrame, built_in: DataFrame) -> DataFrame:
        kept = answered.join(good, "run_id", "left_semi")
        return kept.unionByName(built_in.join(good, "run_id", "left_anti"))

    def evidence(final_people: DataFrame, final_documents: DataFrame) -> DataFrame:
        whole = F.to_json(F.try_variant_get(F.try_parse_json("reply"), "$.evidence_map", "variant"))
        return merged(evidence_map.parsed(answers.select("run_id", whole.alias("value"))), evidence_map.made(final_people, final_documents))

    return merged(answered_people, people), merged(answered_documents, documents), evidence


def write_evidence(rows: DataFrame, path: str, form: str = FORM) -> str:
    """Evidence map as one JSON object, or as a folder of its rows."""
    if form == FOLDER:
        return write_artifact(rows, F.to_json(F.struct("place", "part", "name", "value")), ["place"], path)
    return write_artifact(evidence_map.pieces(rows), F.col("piece"), ["step", "place"], path, FILE, "{\n", "", "}\n")


def read_evidence(spark: SparkSession, run_dir: str) -> DataFrame:
    """Rows of the stored evidence map, in either form; a run without one has none."""
    path = artifact(run_dir, "analyze", "evidence_map")
    found = kind(path)
    if found is None:
        return evidence_map.empty(spark)
    if found == FOLDER:
        rows = spark.read.schema("place BIGINT, part STRING, name STRING, value STRING").json(literal(absolute(path)))
        return rows.select(F.lit(RUN).alias("run_id"), "*")
    text = spark.read.text(literal(absolute(path)), wholetext=True)
    return evidence_map.parsed(text.select(F.lit(RUN).alias("run_id"), "value"))


def generate(
    spark: SparkSession, run_dir: str, transport: remote.Transport = remote.post_json, form: str = FORM
) -> dict[str, Any]:
    endpoint = cfg.endpoint(cfg.load_config(run_dir), "generator", "generate", run_dir)
    people = cand.with_match_texts(read(spark, run_dir, "analyze", "candidate_profile"))
    documents = read(spark, run_dir, "analyze", "jd_profiles")
    made = variants.jd_variants(documents, people)
    if endpoint is not None:
        made = told_summaries(made, documents, people, endpoint, transport, reply_log(run_dir, "generate"))
    path = artifact(run_dir, "generate", "resume_variants")
    write_records(made.withColumnRenamed("variant_cluster", "cluster"), path, "resume_variants", form=form)
    return {"variants": read(spark, run_dir, "generate", "resume_variants").count()}


def told_summaries(
    made: DataFrame, documents: DataFrame, people: DataFrame, endpoint: cfg.Endpoint, transport: remote.Transport, log: str
) -> DataFrame:
    """Variants with the remote generator's summaries, which is told of their documents and candidates."""
    told = documents.select("run_id", F.col("jd_index").alias("variant_ord"), "title", "company", "keywords")
    asked = made.join(told, ["run_id", "variant_ord"]).join(people.select("run_id", "strengths"), "run_id")
    return remote.remote_summaries(asked, endpoint, transport, log).select(*made.columns)


def task_total(spark: SparkSession, run_dir: str) -> int:
    documents = read(spark, run_dir, "analyze", "jd_profiles").select("run_id", "jd_id")
    return variants.work_items(documents, variants_of(spark, run_dir)).count()


def evaluate(
    spark: SparkSession,
    run_dir: str,
    progress: Progress | None = None,
    transport: remote.Transport = remote.post_json,
    assess: Callable[[DataFrame], DataFrame] | None = None,
    form: str = FORM,
) -> dict[str, Any]:
    """Score, judge and explain all pairs. ``assess`` may replace the judge with own columns.

    ``progress`` is told while the work runs: after every group of remote calls, or after every batch of
    pairs, with the pairs done so far, the last of them, its outcome and the time that the group took.
    """
    endpoint = cfg.endpoint(cfg.load_config(run_dir), "judge", "evaluate", run_dir)
    people = read(spark, run_dir, "analyze", "candidate_profile")
    documents = read(spark, run_dir, "analyze", "jd_profiles")
    pairs = judge.with_review(stages.scored_pairs(documents, people, variants_of(spark, run_dir)))
    provider, model = judge.DETERMINISTIC, judge.HEURISTIC_MODEL
    asks = assess is None and endpoint is not None
    log = reply_log(run_dir, "evaluate")
    notes = os.path.join(log, remote.ASSESSED) if asks else replies.new_log(spark)
    # Where tasks cannot write notes, there is no progress to tell of.
    watched = progress is not None and opens_in_tasks(notes)
    watch = replies.Watch(notes, task_total(spark, run_dir), progress) if watched else contextlib.nullcontext()
    with watch:
        if asks:
            provider, model = endpoint.provider, endpoint.model
            judged = remote.remote_assessments(pairs, read_evidence(spark, run_dir), endpoint, transport, log)
        else:
            judged = judge.with_assessment(pairs) if assess is None else assess(pairs)
        rows = stages.settled(judged, provider, model)
        rows = durable(replies.noted(rows, notes) if watched and not asks else rows)
    gaps = ranking.gap_maps(documents, people, rows)
    tables = {
        "scorecards": rows,
        "gap_maps": gaps,
        "ranking_explanations": rows,
        "llm_assessments": stages.assessments(rows),
        "llm_failures": judge.failure_rows(rows),
        "eval_summary": ranking.eval_summary(rows),
    }
    for name, table in tables.items():
        write_records(table, artifact(run_dir, "evaluate", name), name, form=form)
    counts = rows.agg(F.count("*").alias("n"), F.count_if("assessed").alias("ok")).head()
    return {"scorecards": counts["n"], "ok": counts["ok"], "gap_maps": documents.count()}


def explanations_of(spark: SparkSession, run_dir: str, cards: DataFrame) -> DataFrame:
    stored = read(spark, run_dir, "evaluate", "ranking_explanations", optional_file=True)
    return explain.complete_explanations(stored, cards, read(spark, run_dir, "evaluate", "gap_maps"))


def plan(
    spark: SparkSession, run_dir: str, transport: remote.Transport = remote.post_json, form: str = FORM
) -> dict[str, Any]:
    endpoint = cfg.endpoint(cfg.load_config(run_dir), "planner", "plan", run_dir)
    cards = read(spark, run_dir, "evaluate", "scorecards")
    rows = stages.rejoined(
        cards,
        read(spark, run_dir, "analyze", "jd_profiles"),
        read(spark, run_dir, "analyze", "candidate_profile"),
        variants_of(spark, run_dir),
        assessed := read(spark, run_dir, "evaluate", "llm_assessments", optional_file=True),
        read(spark, run_dir, "evaluate", "llm_failures", optional_file=True),
        explanations_of(spark, run_dir, cards),
    )
    planned = strategy.planned(stages.ranked_best(rows))
    if endpoint is not None:
        whole = stages.whole_assessments(assessed)
        asked = planned.join(whole, stages.PAIR, "left")
        planned = remote.remote_strategies(asked, endpoint, transport, reply_log(run_dir, "plan"))
    path = artifact(run_dir, "plan", "application_strategies")
    write_records(strategy.backfilled(planned), path, "application_strategies", form=form)
    return {"strategies": read(spark, run_dir, "plan", "application_strategies").count()}


def report_rows(spark: SparkSession, run_dir: str) -> DataFrame:
    """Report blocks of a run from its stored artifacts."""
    cards = read(spark, run_dir, "evaluate", "scorecards")
    plans, documents = read(spark, run_dir, "plan", "application_strategies"), read(spark, run_dir, "analyze", "jd_profiles")
    return report.report_blocks(stages.report_joined(plans, documents, cards, explanations_of(spark, run_dir, cards)))


def write_report(spark: SparkSession, run_dir: str, title: str = report.TITLE, form: str = FORM) -> str:
    cfg.load_config(run_dir)
    person = read(spark, run_dir, "analyze", "candidate_profile").select("candidate_id").head()["candidate_id"]
    head = "\n".join(report.header_lines(person, run_dir, title))
    blocks = report_rows(spark, run_dir).select(F.col("priority_rank").cast("long").alias("rank"), "block")
    header = spark.range(1).select(F.lit(0).cast("long").alias("rank"), F.lit(head).alias("block"))
    value = F.to_json(F.struct("rank", "block")) if form == FOLDER else F.col("block")
    return write_artifact(header.unionByName(blocks), value, ["rank"], os.path.join(run_dir, "report", "summary.md"), form)
