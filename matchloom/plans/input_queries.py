"""Queries over inputs, names, uploads, run listings and language checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import language as lang
from matchloom.functions import naming as nm
from matchloom.functions import scoring as sc
from matchloom.functions import text as tx
from matchloom.operators import viewer
from matchloom.plans import adapters as ad
from matchloom.plans import oracle as sql
from matchloom.plans.registry import registered
from matchloom.sources import files, uploads

# Vowels become Chinese characters, so that texts fall on both sides of the language check.
VOWELS, GLYPHS = "aeio", "中文简历"


@registered(
    "zh_dominance",
    f"""SELECT doc_id, NOT {sql.blank('t')} AND cjk > 0 AND cjk / (cjk + latin) >= 0.45e0 AS dominant
    FROM (SELECT doc_id, t, CAST(len(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]')) AS DOUBLE) AS cjk,
                 CAST(len(regexp_extract_all(t, '[A-Za-z]')) AS DOUBLE) AS latin
          FROM (SELECT doc_id, translate(text, '{VOWELS}', '{GLYPHS}') AS t FROM documents))""",
)
def zh_dominance(spark: SparkSession, folder: str) -> DataFrame:
    text = F.translate("text", VOWELS, GLYPHS)
    return ad.documents(spark, folder).select("doc_id", lang.chinese_dominant(text).alias("dominant"))


def sql_identifier(x: str) -> str:
    inner = sql.strip(x)
    return (
        f"({inner} = '' OR regexp_full_match({inner}, '[A-Za-z0-9_.:/@#\\-\\[\\]]+') "
        f"OR (length({inner}) <= 5 AND regexp_matches({inner}, '[A-Za-z]')))"
    )


@registered(
    "identifier_like",
    f"""SELECT doc_id, {sql_identifier('lang')} AS short_like, {sql_identifier('source')} AS name_like,
    {sql_identifier('text')} AS text_like FROM documents""",
)
def identifier_like(spark: SparkSession, folder: str) -> DataFrame:
    return ad.documents(spark, folder).select(
        "doc_id",
        lang.identifier_like(F.col("lang")).alias("short_like"),
        lang.identifier_like(F.col("source")).alias("name_like"),
        lang.identifier_like(F.col("text")).alias("text_like"),
    )


def sql_natural(x: str) -> str:
    dominant = (
        f"(len(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}]')) > 0 AND len(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}]'))"
        f" >= 0.45e0 * (len(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fff}}]')) + len(regexp_extract_all({x}, '[A-Za-z]'))))"
    )
    return f"(NOT {sql_identifier(x)})", f"({sql_identifier(x)} OR {dominant})"


NATURAL, GOOD = sql_natural("leaf")


@registered(
    "json_language_check",
    f"""SELECT conv_id, turn, bool_or({NATURAL}) AND bool_and({GOOD}) AS whole,
    bool_and({GOOD}) FILTER (WHERE place = 1) AS reason
    FROM (SELECT conv_id, turn, unnest([t, role, text, t]) AS leaf, unnest([1, 2, 3, 4]) AS place
          FROM (SELECT *, translate(text, '{VOWELS}', '{GLYPHS}') AS t FROM conversations)) GROUP BY conv_id, turn""",
)
def json_language_check(spark: SparkSession, folder: str) -> DataFrame:
    """Nested JSON replies, checked as a whole and below one key."""
    text = F.translate("text", VOWELS, GLYPHS)
    nested = F.struct(F.array("role", "text").alias("parts"), text.alias("note"))
    reply = F.to_json(F.struct(text.alias("reason"), nested.alias("detail")))
    replies = ad.table(spark, folder, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return replies.select(
        "conv_id",
        "turn",
        lang.texts_chinese(lang.json_texts(F.col("reply")), True).alias("whole"),
        lang.texts_chinese(F.array(F.get_json_object("reply", "$.reason")), False).alias("reason"),
    )


@registered(
    "json_payload",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value > 10 AS is_object FROM events""",
)
def json_payload(spark: SparkSession, folder: str) -> DataFrame:
    """JSON objects out of code fences; a bare number is JSON but no object."""
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    either = F.when(F.col("value") > 10, fenced).otherwise(F.get_json_object("props", "$.k"))
    kind = F.schema_of_variant(F.try_parse_json(lang.unfenced(either)))
    return ad.table(spark, folder, "events").select(
        "event_id",
        F.try_variant_get(F.try_parse_json(lang.unfenced(fenced)), "$.k", "bigint").alias("k"),
        F.startswith(kind, F.lit("OBJECT")).alias("is_object"),
    )


SLUG = "trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-')[1:48]"


@registered(
    "run_slug",
    f"""SELECT page_id, CASE WHEN {SLUG} = '' THEN 'run' ELSE {SLUG} END || '-20260425-083000' AS run_id FROM pages""",
)
def run_slug(spark: SparkSession, folder: str) -> DataFrame:
    moment = F.lit("2026-04-25 08:30:00").cast("timestamp_ntz")
    return ad.table(spark, folder, "pages").select("page_id", nm.run_identifier(F.col("url"), moment).alias("run_id"))


@registered(
    "next_command",
    f"""SELECT page_id, 'python -m matchloom run --run-dir ./runs/' || run || ' --candidate-id cand-' || page_id
    || ' --cv ./runs/' || run || '/input_files/cv --jd ./runs/' || run || '/input_files/jd' AS command
    FROM (SELECT page_id, {SLUG} AS run FROM pages)""",
)
def next_command(spark: SparkSession, folder: str) -> DataFrame:
    slug = F.substring(F.btrim(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "-"), F.lit("-")), 1, 48)
    run, person = slug, F.format_string("cand-%d", "page_id")
    return ad.table(spark, folder, "pages").select("page_id", nm.next_command(run, person).alias("command"))


def upload_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names out of page addresses: with paths, without suffix, supported and not."""
    suffixes = F.array(*[F.lit(suffix) for suffix in (".md", ".PDF", ".exe", "", ".jpeg")])
    last = F.regexp_extract("url", "([^/]*)$", 1)
    whole = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(last)
    return ad.table(spark, folder, "pages").select(
        "page_id",
        F.concat(whole, F.get(suffixes, (F.col("page_id") % 5).cast("int"))).alias("name"),
        (F.length("html") * 7919 % (12 * 1024 * 1024) * (F.col("page_id") % 7 > 0).cast("int")).cast("long").alias("size_bytes"),
    )


UPLOAD_NAMES = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_extract(url, '([^/]*)$', 1) END
    || ['.md', '.PDF', '.exe', '', '.jpeg'][page_id % 5 + 1] AS name,
    length(html) * 7919 % (12 * 1024 * 1024) * CASE WHEN page_id % 7 > 0 THEN 1 ELSE 0 END AS size_bytes FROM pages"""
STORED = "trim(regexp_replace(replace(name, chr(92), '/'), '[^a-zA-Z0-9._-]+', '-', 'g'), '-')"
EXTENSION = "lower(regexp_extract(replace(name, chr(92), '/'), '^.*[^/](\\.[^./]*)$', 1))"


@registered(
    "upload_validation",
    f"""SELECT page_id, {STORED} AS stored, CASE WHEN size_bytes = 0 THEN 'empty_file'
        WHEN size_bytes > 10485760 THEN 'file_too_large'
        WHEN {EXTENSION} NOT IN ('.txt', '.md', '.pdf', '.png', '.jpg', '.jpeg') THEN 'unsupported_file_type'
        WHEN contains(name, '/') OR contains(name, '..') OR {STORED} = '' THEN 'unsafe_filename' END AS error_code
    FROM ({UPLOAD_NAMES})""",
)
def upload_validation(spark: SparkSession, folder: str) -> DataFrame:
    checked = uploads.validate_uploads(upload_names(spark, folder))
    return checked.select("page_id", nm.stored_name(F.col("name")).alias("stored"), "error_code")


def scanned_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as scanned inputs; the reader reported those of one source as unreadable."""
    unread = F.col("source") == "src3"
    return ad.documents(spark, folder).select(
        F.col("lang").alias("run_id"),
        F.col("doc_id").alias("input_ord"),
        F.lit("file").alias("source_type"),
        F.format_string("./input_files/cv/doc-%d.md", "doc_id").alias("source_value"),
        F.format_string("/data/elsewhere/doc-%d.md", "doc_id").alias("resolved_path"),
        F.format_string("doc-%d.md", "doc_id").alias("original_name"),
        F.col("n_chars").alias("size_bytes"),
        F.lit("text/markdown").alias("media_type"),
        F.col("text"),
        F.when(unread, F.lit(files.UNPARSEABLE)).otherwise(F.lit(files.EXTRACTED)).alias("extraction_status"),
        F.lit(files.LOCAL_TEXT).alias("extraction_provider"),
        F.when(unread, F.lit("unreadable")).otherwise(F.lit("")).alias("extraction_error"),
    )


def upload_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One upload manifest per labelled document, with a stale first entry, a bad size and junk items."""
    path = F.format_string("input_files\\\\cv\\\\doc-%d.md", "doc_id")
    size = F.when(F.col("toxic") == 1, F.lit('"many"')).otherwise((F.col("quality") * 100 + 1).cast("string"))
    entry = F.concat(
        F.lit('{"role": "jd", "originalName": "Original '), F.col("doc_id").cast("string"),
        F.lit('.md", "storedRelativePath": "'), path, F.lit('", "sizeBytes": '), size, F.lit("}"),
    )
    stale = F.concat(F.lit('{"role": "cv", "storedRelativePath": "'), path, F.lit('"}'))
    value = F.concat(F.lit('{"files": [7, {"storedRelativePath": " "}, '), stale, F.lit(", "), entry, F.lit("]}"))
    marked = ad.table(spark, folder, "labels").join(ad.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    return marked.select(F.col("lang").alias("run_id"), value.alias("value"))


@registered(
    "manifest_items",
    """SELECT d.doc_id AS input_ord, CASE WHEN l.doc_id IS NULL THEN 'cv' ELSE 'jd' END AS role,
    CASE WHEN l.doc_id IS NULL THEN 'cli' ELSE 'upload' END AS source_origin,
    CASE WHEN l.doc_id IS NULL THEN 'doc-' || d.doc_id || '.md' ELSE 'Original ' || d.doc_id || '.md' END AS original_name,
    CASE WHEN l.doc_id IS NULL THEN './' ELSE '' END || 'input_files/cv/doc-' || d.doc_id || '.md' AS relative_path,
    CASE WHEN l.doc_id IS NULL THEN n_chars WHEN toxic = 1 THEN 0 ELSE quality * 100 + 1 END::BIGINT AS size_bytes
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def manifest_items(spark: SparkSession, folder: str) -> DataFrame:
    items = uploads.upload_items(upload_manifests(spark, folder))
    rows = uploads.manifest_items(scanned_documents(spark, folder), items, "cv", "/data/runs/none")
    return rows.select("input_ord", "role", "source_origin", "original_name", "relative_path", "size_bytes")


@registered(
    "manifest_warnings",
    """SELECT d.doc_id AS input_ord, CASE WHEN l.doc_id IS NULL THEN 'cv' ELSE 'jd' END AS role,
    CASE WHEN l.doc_id IS NULL THEN './' ELSE '' END || 'input_files/cv/doc-' || d.doc_id || '.md' AS relative_path,
    'unreadable' AS extraction_error
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE source = 'src3'""",
)
def manifest_warnings(spark: SparkSession, folder: str) -> DataFrame:
    items = uploads.upload_items(upload_manifests(spark, folder))
    rows = uploads.manifest_items(scanned_documents(spark, folder), items, "cv", "/data/runs/none")
    return uploads.input_warnings(rows).select("input_ord", "role", "relative_path", "extraction_error")


@registered(
    "input_sources",
    """SELECT d.doc_id, 'cli' AS source_origin, 'doc-' || d.doc_id || '.md' AS original_name, n_chars AS size_bytes,
    'extracted' AS extraction_status, CASE WHEN n_chars <= 0 THEN '--' WHEN n_chars < 1024 THEN n_chars || ' B'
        ELSE (CAST(floor(n_chars * 10 / 1024e0 + 0.5e0) AS BIGINT) // 10) || '.'
             || (CAST(floor(n_chars * 10 / 1024e0 + 0.5e0) AS BIGINT) % 10) || ' KB' END AS shown_size
    FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL
    SELECT l.doc_id, 'upload', 'label-' || l.doc_id || '.md', quality * 3000::BIGINT, 'draft',
    CASE WHEN quality = 0 THEN '--' ELSE '2.9 KB' END
    FROM labels l""",
)
def input_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs of runs: unlabelled documents are ingested ones, labelled ones stand in upload drafts."""
    documents, labels = ad.table(spark, folder, "documents"), ad.table(spark, folder, "labels")
    ingested = documents.join(labels.select("doc_id"), "doc_id", "left_anti").select(
        F.concat(F.lit("run-"), "lang").alias("run_id"),
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("source_origin"),
        F.lit(None).cast("string").alias("original_name"),
        F.lit(None).cast("string").alias("relative_path"),
        F.format_string("inputs/doc-%d.md", "doc_id").alias("source_value"),
        F.col("n_chars").alias("size_bytes"),
        F.lit("extracted").alias("extraction_status"),
        F.lit(None).cast("string").alias("extraction_error"),
        F.col("doc_id").alias("position"),
    )
    drafts = labels.join(documents.select("doc_id", "lang"), "doc_id").select(
        F.concat(F.lit("draft-"), "lang").alias("run_id"),
        F.lit("cv").alias("role"),
        F.format_string("label-%d.md", "doc_id").alias("original_name"),
        F.format_string("input_files/cv/label-%d.md", "doc_id").alias("relative_path"),
        (F.col("quality") * 3000).alias("size_bytes"),
        F.col("doc_id").alias("position"),
    )
    rows = viewer.input_sources(ingested, drafts)
    return rows.select(
        F.regexp_extract("original_name", r"(\d+)", 1).cast("long").alias("doc_id"),
        "source_origin", "original_name", "size_bytes", "extraction_status", "shown_size",
    )


@registered(
    "text_inputs",
    """SELECT lang AS run_id, doc_id % 50 AS role, count(*) AS n_inputs, CASE WHEN NOT bool_or(n_chars % 40 = 0 AND text <> '')
        THEN 'At least one ' || doc_id % 50 || ' input must contain extractable text.' END AS problem
    FROM documents GROUP BY lang, doc_id % 50""",
)
def text_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Which roles of a run have no usable input: most texts are blanked, with the white space of several scripts."""
    blank = F.regexp_replace("text", r"[^ \n]+", "\u00a0\u2003")
    rows = ad.table(spark, folder, "documents").select(
        F.col("lang").alias("run_id"), (F.col("doc_id") % 50).alias("role"),
        F.when(F.col("n_chars") % 40 == 0, F.col("text")).otherwise(blank).alias("text"),
    )
    return files.text_problems(rows, ["run_id", "role"], F.col("role").cast("string"))


@registered(
    "path_names",
    """SELECT page_id, regexp_replace(replace('.\\\\' || replace(url, '/', chr(92)), chr(92), '/'), '^[./]+', '') AS path,
    coalesce(lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.*[^.].*?(\\.[^.]+)$', 1)), '') AS suffix FROM pages""",
)
def path_names(spark: SparkSession, folder: str) -> DataFrame:
    windows = F.concat(F.lit(".\\\\"), F.replace("url", F.lit("/"), F.lit("\\")))
    return ad.table(spark, folder, "pages").select(
        "page_id", nm.manifest_path(windows).alias("path"), nm.suffix(F.col("url")).alias("suffix")
    )


KINDS = (".jpg", ".PNG", ".txt", ".md", ".markdown", ".pdf", ".tif", ".exe")


@registered(
    "media_types",
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain'
        WHEN 3 THEN 'text/markdown' WHEN 4 THEN 'text/markdown' WHEN 5 THEN 'application/pdf' WHEN 6 THEN 'image/tiff'
        ELSE 'application/octet-stream' END AS media_type, md5(to_base64(encode(html))) AS content_md5 FROM pages""",
)
def media_types(spark: SparkSession, folder: str) -> DataFrame:
    """Media type by suffix and the base64 body of a data URL."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    extension = F.lower(F.get(kinds, (F.col("page_id") % len(KINDS)).cast("int")))
    url = nm.data_url(extension, F.encode("html", "UTF-8"))
    return ad.table(spark, folder, "pages").select(
        "page_id",
        nm.media_type(extension).alias("media_type"),
        F.md5(F.encode(F.regexp_replace(F.substring_index(url, ";base64,", -1), r"\s", ""), "UTF-8")).alias("content_md5"),
    )


@registered(
    "pdf_literals",
    r"""SELECT conv_id, turn, array_to_string(list_transform(
        regexp_extract_all(regexp_replace('BT (' || replace(replace(replace(text, chr(92), ''), '(', ''), ')', '')
            || ')' || chr(160) || 'Tj (second \\ part)  Tj (lost) TJ ET', '[^\x{0}-\x{ff}]', '?', 'g'),
            '\(([^()]*)\)[\s\x0b\x1c-\x1f\x{85}\x{a0}]*Tj', 1),
        lambda s: replace(s, '\\', '\')), chr(10)) AS literals FROM conversations""",
)
def pdf_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Literal scan over content streams made of whole turns, with Latin-1 letters and a no-break space."""
    plain = F.regexp_replace("text", r"[\\()]", "")
    stream = F.concat(F.lit("BT ("), plain, F.lit(")\u00a0Tj (second \\\\ part)  Tj (lost) TJ ET"))
    latin_only = F.regexp_replace(stream, r"[^\x00-\xff]", "?")
    return ad.table(spark, folder, "conversations").select(
        "conv_id", "turn", files.pdf_literals(F.encode(latin_only, "ISO-8859-1")).alias("literals")
    )


def scan_listing(spark: SparkSession, folder: str) -> DataFrame:
    """A file listing out of page ids: images, their sidecars, hidden and skipped folders, odd suffixes.

    As in a real scan, rows are names; a digest stands for what a file holds.
    """
    stems = F.format_string("/inputs/%s/file-%d", F.element_at(
        F.array(*[F.lit(name) for name in ("a", "b/.hidden", "node_modules", "c/d")]), (F.col("page_id") % 4 + 1).cast("int")
    ), "page_id")
    kinds = F.array(*[F.lit(kind) for kind in (".png", ".txt", ".JPG", ".md", ".pdf", ".exe")])
    # Which of the files exist beside each other differs from stem to stem.
    mine = F.filter(kinds, lambda kind: F.length(kind) + F.col("page_id") % 3 != 5)
    named = ad.table(spark, folder, "pages").select(F.explode(mine).alias("kind"), stems.alias("stem_path"), "html")
    return named.select(F.concat("stem_path", "kind").alias("path"), F.md5(F.encode(F.concat("kind", "html"), "UTF-8")).alias("digest"))


@registered(
    "scan_files",
    """WITH e AS (SELECT page_id, kind, html, ['a', 'b/.hidden', 'node_modules', 'c/d'][page_id % 4 + 1] AS dir
        FROM (SELECT page_id, html, unnest(['.png', '.txt', '.JPG', '.md', '.pdf', '.exe']) AS kind FROM pages)
        WHERE length(kind) + page_id % 3 <> 5),
    f AS (SELECT * FROM e WHERE dir NOT IN ('b/.hidden', 'node_modules'))
    SELECT dir || '/file-' || page_id || kind AS relative, lower(kind) AS suffix,
        CASE WHEN kind IN ('.png', '.JPG') THEN (SELECT md5(min_by(g.kind || g.html, CASE g.kind WHEN '.txt' THEN 0 ELSE 1 END))
            FROM f g WHERE g.page_id = f.page_id AND g.kind IN ('.txt', '.md')) END AS sidecar_md5
    FROM f WHERE kind <> '.exe' AND NOT (kind IN ('.txt', '.md') AND EXISTS (
        SELECT 1 FROM f i WHERE i.page_id = f.page_id AND i.kind = '.png'))""",
)
def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    listed = files.list_files(scan_listing(spark, folder), F.lit("/inputs"))
    inputs = files.with_sidecars(files.without_sidecars(listed), listed)
    return inputs.select("relative", "suffix", F.col("sidecar.digest").alias("sidecar_md5"))


@registered(
    "image_cascade",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'vision' WHEN 2 THEN 'sidecar' ELSE 'unparseable' END
        AS extraction_status,
    CASE page_id % 4 WHEN 0 THEN 'seen ' || length(html) WHEN 1 THEN 'shown ' || length(html) WHEN 2 THEN html ELSE '' END AS text,
    CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'ocr: OCR returned empty text.'
        WHEN 2 THEN 'ocr: OCR returned empty text.; vision: no vision' ELSE 'Image input' END AS error_start FROM pages""",
)
def image_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """The image cascade over stand-in readers: OCR, else vision, else the sidecar, else an error row."""

    def ocr(data: bytes, languages: str) -> str:
        return f"seen {len(data[1:].decode('utf-8'))}" if data[:1] == b"0" else ""

    def vision(data: bytes, media: str, ocr_error: str) -> str:
        if data[:1] != b"1":
            raise RuntimeError("no vision")
        return f"shown {len(data[1:].decode('utf-8'))}"

    tools = files.Extractors(ocr=ocr, vision=vision, vision_provider="stand_in")
    mark = (F.col("page_id") % 4).cast("string")
    images = ad.table(spark, folder, "pages").select(
        "page_id",
        F.format_string("scan-%d.png", "page_id").alias("source_value"),
        F.lit(".png").alias("suffix"),
        F.encode(F.concat(mark, "html"), "UTF-8").alias("content"),
        F.when(F.col("page_id") % 4 == 2, F.encode("html", "UTF-8")).alias("sidecar"),
    )
    read = files.extract(images, tools)
    failed = F.col("extraction_status") == files.UNPARSEABLE
    error = F.when(failed, F.substring("extraction_error", 1, 11)).otherwise(F.col("extraction_error"))
    return read.select("page_id", "extraction_status", "text", error.alias("error_start"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts of runs: the run is the host of a page, the artifact depends on its number."""
    known = [path for path, _ in viewer.REQUIRED_FILES] + [viewer.DRAFT_FILE]
    pick = F.get(F.array(*[F.lit(path) for path in known]), (F.col("page_id") % 11).cast("int"))
    return ad.table(spark, folder, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("run_id"),
        F.coalesce(pick, "url").alias("artifact"),
        "page_id",
    )


@registered(
    "stage_completeness",
    sql.query("SELECT run_id, array_to_string(done, ',') AS completed_stages, has_draft FROM stages"),
)
def stage_completeness(spark: SparkSession, folder: str) -> DataFrame:
    stages = viewer.completed_stages(listing(spark, folder))
    return stages.select("run_id", F.array_join("completed_stages", ",").alias("completed_stages"), "has_draft")


@registered(
    "draft_status",
    sql.query(
        """SELECT run_id, CASE WHEN list_contains(done, 'report') THEN 'complete' WHEN len(done) > 0 THEN 'running'
        WHEN has_draft THEN 'draft' ELSE 'ingest-ready' END AS draft_status FROM stages"""
    ),
)
def draft_status(spark: SparkSession, folder: str) -> DataFrame:
    return viewer.completed_stages(listing(spark, folder)).select("run_id", viewer.draft_status().alias("draft_status"))


@registered(
    "run_list",
    """SELECT 'user-' || user_id AS run_id, row_number() OVER (ORDER BY max(ts) DESC, 'user-' || user_id) AS position
    FROM events GROUP BY user_id""",
)
def run_list(spark: SparkSession, folder: str) -> DataFrame:
    runs = ad.table(spark, folder, "events").groupBy(F.format_string("user-%d", "user_id").alias("run_id")).agg(
        F.max(F.col("ts").cast("timestamp")).alias("last_modified")
    )
    return viewer.run_list(runs).select("run_id", "position")


@registered(
    "run_totals",
    sql.query(
        """SELECT count(*) AS runs, sum(len(done))::BIGINT AS completed_stage_count, max_by(run_id, ROW(m, run_id)) AS latest_run,
        max_by(len(done), ROW(m, run_id)) AS latest_completed
        FROM stages JOIN (SELECT run_id, max(page_id) AS m FROM listing GROUP BY run_id) USING (run_id)"""
    ),
)
def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = listing(spark, folder)
    changed = rows.groupBy("run_id").agg(F.max("page_id").alias("last_modified"))
    return viewer.run_totals(viewer.completed_stages(rows).join(changed, "run_id"))


@registered(
    "unique_text",
    f"""SELECT conv_id, turn, array_to_string(list_filter(w, lambda t, i: list_position(w, t) = i), ' ') AS kept
    FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda t: {sql.strip('t')}),
                                            lambda t: t <> '') AS w FROM conversations)""",
)
def unique_text(spark: SparkSession, folder: str) -> DataFrame:
    words: Column = F.split("text", " ")
    return ad.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.array_join(tx.distinct_texts(words), " ").alias("kept")
    )


@registered(
    "display_names",
    f"""SELECT event_id, CASE event_type WHEN 'click' THEN '岗位定制版本' WHEN 'view' THEN '岗位簇版本' ELSE event_type END AS kind,
    'variant-variant-jd-' || event_id AS anchor, '岗位定制版本（' || event_id || '）' AS shown_name,
    CAST(floor(greatest(0e0, least(1e0, value / 100)) * 100 + 0.5e0) AS BIGINT) AS percent FROM events""",
)
def display_names(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    variant_type = F.when(kind == "click", "jd-specific").when(kind == "view", "cluster").otherwise(kind)
    variant_id = F.concat(F.lit("variant-jd-"), F.col("event_id").cast("string"))
    return ad.table(spark, folder, "events").select(
        "event_id",
        nm.variant_type_label(variant_type).alias("kind"),
        nm.variant_anchor(variant_id).alias("anchor"),
        nm.variant_display_name(variant_id).alias("shown_name"),
        sc.percent(F.col("value") / 100).alias("percent"),
    )


