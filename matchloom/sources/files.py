"""Document inputs: directory scans, text extraction and the image cascade."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import naming as nm
from matchloom.functions import text as tx
from matchloom.operators.ordering import numbered
from matchloom.sources import listing
from matchloom.sources.paths import filesystem, opens_in_tasks

# Extraction states and providers.
EXTRACTED, OCR, VISION, SIDECAR, UNPARSEABLE = "extracted", "ocr", "vision", "sidecar", "unparseable"
LOCAL_TEXT, LOCAL_PDF, LOCAL_OCR = "local_text", "local_pdf", "local_ocr"
DISABLED = "disabled"
SIDECAR_SUFFIXES = (".txt", ".md")
PDF_LITERAL = rf"\(([^()]*)\){tx.SPACE}*Tj"

#: Columns that ``list_files`` adds to a listing.
LISTED = ("relative", "raw_suffix", "stem", "suffix")
#: Bytes of files that one task opens, and what a file counts beside its bytes.
TASK_BYTES, FILE_COST = 128 * 1024 * 1024, 64 * 1024
IMAGE_REPLY = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("ocr_text", "ocr_error", "vision_text", "vision_error")]
)


class InputExtractionError(ValueError):
    """An input source that cannot be read at all."""


@dataclass
class Extractors:
    """Readers for content Spark has no function for; replace them to plug in other tools.

    ``pdf`` gets the bytes and gives text or None, ``ocr`` gets bytes and languages, ``vision``
    gets bytes, media type and the OCR error. ``ocr`` and ``vision`` may raise.
    """

    pdf: Callable[[bytes], str | None] | None = None
    ocr: Callable[[bytes, str], str] | None = None
    vision: Callable[[bytes, str, str], str] | None = None
    ocr_provider: str = LOCAL_OCR
    vision_provider: str = DISABLED
    ocr_languages: str = "eng+chi_sim"
    missing_ocr: str = field(default="Tesseract OCR requires Pillow, pytesseract, and the Tesseract executable.")


def list_files(files: DataFrame, root: Column) -> DataFrame:
    """Add relative path, suffix and stem to listed files and drop skipped directories."""
    relative = F.regexp_replace(F.substring(F.col("path"), F.length(root) + 1, F.length("path")), "^/+", "")
    parts = F.split("relative", "/")
    skipped = F.exists(parts, lambda part: part.isin(*nm.SKIPPED_DIRECTORIES) | F.startswith(part, F.lit(".")))
    return (
        files.withColumn("relative", relative)
        .filter(~skipped)
        .withColumns(
            {
                "raw_suffix": F.regexp_extract(nm.file_name(F.col("relative")), r"^.*[^.].*?(\.[^.]+)$", 1),
                "stem": nm.stem(F.col("relative")),
            }
        )
        .withColumn("suffix", F.lower("raw_suffix"))
    )


def without_sidecars(listed: DataFrame) -> DataFrame:
    """Supported inputs, less the texts that only accompany an image of the same stem."""
    supported = listed.filter(F.col("suffix").isin(*nm.SUPPORTED_SUFFIXES))
    images = listed.filter(F.col("raw_suffix").isin(*nm.IMAGE_MEDIA)).select("stem").distinct()
    is_text = F.col("suffix").isin(*nm.TEXT_SUFFIXES)
    beside_image = images.withColumn("_image", F.lit(True))
    return (
        supported.join(beside_image, "stem", "left")
        .filter(~(is_text & F.coalesce("_image", F.lit(False))))
        .drop("_image")
    )


def with_sidecars(inputs: DataFrame, listed: DataFrame) -> DataFrame:
    """Add ``sidecar``: what is listed of an image's ``.txt``, else ``.md`` file; null without one."""
    texts = listed.filter(F.col("raw_suffix").isin(*SIDECAR_SUFFIXES))
    known = F.struct(*[c for c in listed.columns if c not in LISTED])
    chosen = texts.groupBy("stem").agg(F.max_by(known, F.col("raw_suffix") == SIDECAR_SUFFIXES[0]).alias("_sidecar"))
    is_image = F.col("suffix").isin(*nm.IMAGE_MEDIA)
    return (
        inputs.join(chosen, "stem", "left")
        .withColumn("sidecar", F.when(is_image, F.col("_sidecar")))
        .drop("_sidecar")
    )


def scan_source(spark: SparkSession, source: str, source_ord: int) -> DataFrame:
    """Names of the files of one source argument; a missing or unsupported source raises.

    Nothing is opened here: side-cars are found by name, and ``open_files`` reads the bytes later.
    """
    system, target = filesystem(spark, source)
    if not system.exists(target):
        raise InputExtractionError(f"Input source `{source}` does not exist.")
    root = system.resolvePath(target).toString()
    if system.getFileStatus(target).isDirectory():
        listed = list_files(listing.names_below(spark, root), F.lit(root))
        inputs = without_sidecars(listed)
        if not inputs.select("relative").head(1):
            raise InputExtractionError(f"Input directory `{source}` does not contain supported input files.")
        value = F.concat(F.lit(source.rstrip("/") + "/"), F.col("relative"))
    else:
        extension = os.path.splitext(source)[1]
        if extension.lower() not in nm.SUPPORTED_SUFFIXES:
            raise InputExtractionError(f"Unsupported input type `{extension}` for `{source}`.")
        folder, stem = os.path.split(root)[0], os.path.splitext(root)[0]
        beside = [stem + suffix for suffix in SIDECAR_SUFFIXES if extension.lower() in nm.IMAGE_MEDIA]
        place = spark._jvm.org.apache.hadoop.fs.Path
        present = [(path, system.getFileStatus(place(path)).getLen()) for path in [root, *beside] if system.exists(place(path))]
        listed = list_files(spark.createDataFrame(present, "path STRING, length BIGINT"), F.lit(folder))
        inputs = listed.filter(F.col("path") == root)
        value = F.lit(source)
    resolved = F.regexp_replace("path", "^file:/+", "/")
    return with_sidecars(inputs, listed).select(
        F.lit(source_ord).alias("source_ord"),
        F.split("relative", "/").alias("parts"),
        value.alias("source_value"),
        resolved.alias("resolved_path"),
        "suffix",
        F.col("length").alias("size_bytes"),
        "path",
        F.col("sidecar.path").alias("sidecar_path"),
    )


def open_files(spark: SparkSession, names: DataFrame, sources: list[str]) -> DataFrame:
    """Add ``content`` and ``sidecar`` to named files, in tasks of about ``TASK_BYTES`` each."""
    size = names.agg(F.sum(F.col("size_bytes") + FILE_COST)).head()[0] or 0
    spread = names.repartition(int(size // TASK_BYTES) + 1, "resolved_path")
    contents = {"content": "path", "sidecar": "sidecar_path"}
    roots = [filesystem(spark, source) for source in sources]
    roots = [system.resolvePath(place).toString() for system, place in roots]
    if all(map(opens_in_tasks, roots)):
        return listing.opened(spread, contents).drop("path", "sidecar_path")
    found = listing.hadoop_files(spark, sorted({os.path.split(root)[0] for root in roots}), recursive=True)
    return listing.opened_through_hadoop(spread, contents, found).drop("path", "sidecar_path")


def decoded(content: Column) -> Column:
    """UTF-8 text with line breaks as newlines; bytes that are no UTF-8 stop the job."""
    return F.regexp_replace(F.decode(content, "UTF-8"), r"\r\n?", "\n")


def pdf_literals(content: Column) -> Column:
    """Text operands of a PDF content stream, one per line."""
    literals = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(PDF_LITERAL), 1)

    def unescaped(item: Column) -> Column:
        for escaped, plain in (("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
            item = F.replace(item, F.lit(escaped), F.lit(plain))
        return item

    return F.array_join(F.transform(literals, unescaped), "\n")


def pdf_text(content: Column, reader: Callable[[bytes], str | None] | None) -> Column:
    """Text of the plugged-in reader where it finds any, else the literal scan."""
    literal = pdf_literals(content)
    if reader is None:
        return literal

    @F.pandas_udf("string")
    def pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda data: None if data is None else _quietly(reader, data))

    return F.coalesce(F.nullif(pages(content), F.lit("")), literal)


def _quietly(reader: Callable[[bytes], str | None], data: bytes) -> str | None:
    try:
        text = reader(data) or ""
    except Exception:  # noqa: BLE001 - an unreadable PDF goes on to the literal scan
        return None
    return text if text.strip() else None


def image_text(content: Column, media: Column, extractors: Extractors) -> Column:
    """OCR, and vision where OCR found nothing; every failed step leaves its error."""
    tools = extractors

    @F.pandas_udf(IMAGE_REPLY)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, kinds in batches:
            rows = [_read_image(tools, item, kind) for item, kind in zip(data, kinds, strict=True)]
            yield pd.DataFrame(rows, columns=IMAGE_REPLY.names)

    return read(content, media)


def _read_image(tools: Extractors, data: bytes | None, media: str) -> tuple[str | None, ...]:
    if data is None:
        return None, None, None, None
    try:
        if tools.ocr_provider == DISABLED:
            ocr_error = "OCR provider is disabled."
        elif tools.ocr is None:
            ocr_error = tools.missing_ocr
        else:
            text = tools.ocr(bytes(data), tools.ocr_languages).strip()
            if text:
                return text, None, None, None
            ocr_error = "OCR returned empty text."
    except Exception as error:  # noqa: BLE001 - the next step of the cascade takes over
        ocr_error = str(error).strip() or type(error).__name__
    if tools.vision is None or tools.vision_provider == DISABLED:
        return None, ocr_error, None, "Vision fallback is disabled."
    try:
        text = tools.vision(bytes(data), media, ocr_error).strip()
        return (None, ocr_error, text, None) if text else (None, ocr_error, None, "Vision provider returned empty text.")
    except Exception as error:  # noqa: BLE001
        return None, ocr_error, None, str(error).strip() or type(error).__name__


def extract(files: DataFrame, extractors: Extractors | None = None) -> DataFrame:
    """Text, state, provider and error of every file row; failures stay rows."""
    tools = extractors or Extractors()
    is_text = F.col("suffix").isin(*nm.TEXT_SUFFIXES)
    is_pdf = F.col("suffix").isin(*nm.PDF_SUFFIXES)
    is_image = F.col("suffix").isin(*nm.IMAGE_MEDIA)
    media = nm.media_type(F.col("suffix"))
    read = files.withColumns(
        {
            "media_type": media,
            "_plain": F.when(is_text, decoded(F.col("content"))),
            "_pdf": pdf_text(F.when(is_pdf, F.col("content")), tools.pdf),
            "_image": image_text(F.when(is_image, F.col("content")), media, tools),
        }
    )
    image = F.col("_image")
    by_ocr = is_image & image["ocr_text"].isNotNull()
    by_vision = is_image & image["vision_text"].isNotNull()
    by_sidecar = is_image & F.col("sidecar").isNotNull()
    pdf_ok = is_pdf & ~tx.is_blank(F.col("_pdf"))
    steps = F.concat(F.lit("ocr: "), image["ocr_error"], F.lit("; vision: "), image["vision_error"])
    image_error = F.concat(
        F.lit("Image input `"), F.col("source_value"), F.lit("` could not be extracted. OCR error: "),
        image["ocr_error"], F.lit(". Vision fallback error: "), image["vision_error"],
        F.lit(". Install Tesseract with required language packs, configure a vision model and its key, "
              "or provide a same-name .txt or .md sidecar."),
    )
    pdf_error = F.concat(
        F.lit("PDF input `"), F.col("source_value"),
        F.lit("` did not contain extractable text. Scanned PDFs are not OCRed in this version; "
              "provide a text or markdown sidecar."),
    )
    return read.select(
        *[column for column in files.columns if column not in ("content", "sidecar", "suffix", "parts", "source_ord")],
        F.lit("file").alias("source_type"),
        "media_type",
        F.when(is_text, F.col("_plain"))
        .when(pdf_ok, F.col("_pdf"))
        .when(by_ocr, image["ocr_text"])
        .when(by_vision, image["vision_text"])
        .when(by_sidecar, decoded(F.col("sidecar")))
        .otherwise(F.lit(""))
        .alias("text"),
        F.when(is_text | pdf_ok, F.lit(EXTRACTED))
        .when(by_ocr, F.lit(OCR))
        .when(by_vision, F.lit(VISION))
        .when(by_sidecar, F.lit(SIDECAR))
        .otherwise(F.lit(UNPARSEABLE))
        .alias("extraction_status"),
        F.when(is_text, F.lit(LOCAL_TEXT))
        .when(is_pdf, F.lit(LOCAL_PDF))
        .when(by_ocr, F.lit(tools.ocr_provider))
        .when(by_vision, F.lit(tools.vision_provider))
        .when(by_sidecar, F.lit(SIDECAR))
        .otherwise(F.lit(LOCAL_OCR))
        .alias("extraction_provider"),
        F.when(is_text | pdf_ok | by_ocr, F.lit(""))
        .when(is_pdf, pdf_error)
        .when(by_vision, F.concat(F.lit("ocr: "), image["ocr_error"]))
        .when(by_sidecar, steps)
        .otherwise(image_error)
        .alias("extraction_error"),
        nm.file_name(F.col("source_value")).alias("original_name"),
    )


def collect_documents(
    spark: SparkSession, sources: list[str], run_id: str, extractors: Extractors | None = None
) -> DataFrame:
    """Extracted documents of all sources, numbered in argument order and path order."""
    plain = [source if "://" in source else os.path.normpath(source) for source in sources]
    if not plain:
        raise InputExtractionError("No input source given.")
    scanned = [scan_source(spark, source, position) for position, source in enumerate(plain)]
    named = reduce(DataFrame.unionByName, scanned).withColumn("run_id", F.lit(run_id))
    # Names alone are put in order; the bytes are opened behind that.
    placed = numbered(
        named, ["run_id"], ["source_ord", "resolved_path"], [F.col("source_ord"), F.col("parts")], "input_ord", carry=True
    )
    return extract(open_files(spark, placed, plain), extractors)


def collect_runs(spark: SparkSession, root: str, extractors: Extractors | None = None) -> DataFrame:
    """Extracted documents of many runs, kept as ``root/<run>/<role>/...``: one listing, one numbering and one
    opening of files for all of them. Files that lie above a role's folder belong to no run."""
    system, target = filesystem(spark, root)
    if not system.exists(target):
        raise InputExtractionError(f"Input source `{root}` does not exist.")
    base = system.resolvePath(target).toString()
    listed = list_files(listing.names_below(spark, base), F.lit(base))
    parts = F.split("relative", "/")
    named = with_sidecars(without_sidecars(listed), listed).filter(F.size(parts) > 2).select(
        parts[0].alias("run_id"),
        parts[1].alias("role"),
        F.lit(0).alias("source_ord"),
        parts.alias("parts"),
        F.col("relative").alias("source_value"),
        F.regexp_replace("path", "^file:/+", "/").alias("resolved_path"),
        "suffix",
        F.col("length").alias("size_bytes"),
        "path",
        F.col("sidecar.path").alias("sidecar_path"),
    )
    placed = numbered(named, ["run_id", "role"], ["resolved_path"], [F.col("parts")], "input_ord", carry=True)
    return extract(open_files(spark, placed, [root]), extractors)


def text_problems(documents: DataFrame, key: list[str], label: Column) -> DataFrame:
    """Per key: its number of inputs and what is wrong with them, null where some input has text."""
    counts = documents.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_inputs"), F.max(~tx.is_blank(F.col("text"))).alias("_filled")
    )
    message = F.concat(F.lit("At least one "), label, F.lit(" input must contain extractable text."))
    return counts.select(*key, "n_inputs", F.when(~F.col("_filled"), message).alias("problem"))


def require_text(documents: DataFrame, role: str) -> None:
    """Raise unless some document has text. Reads one flag, not the documents."""
    found = text_problems(documents.withColumn("_all", F.lit(1)), ["_all"], F.lit(role)).head()
    if found is None:
        raise ValueError(f"At least one {role} input is required for ingest.")
    if found["problem"]:
        raise ValueError(found["problem"])
