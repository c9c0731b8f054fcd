"""Identifiers, paths and display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes with their media types.
TEXT_SUFFIXES = (".txt", ".md", ".markdown")
PDF_SUFFIXES = (".pdf",)
IMAGE_MEDIA = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
}
SUPPORTED_SUFFIXES = TEXT_SUFFIXES + PDF_SUFFIXES + tuple(IMAGE_MEDIA)
# Directories a scan never enters.
SKIPPED_DIRECTORIES = (".git", ".next", ".pytest_cache", ".venv", "__pycache__", "build", "dist", "node_modules")
# Limits of an upload.
UPLOAD_SUFFIXES = (".txt", ".md", ".pdf", ".png", ".jpg", ".jpeg")
UPLOAD_LIMIT = 10 * 1024 * 1024


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last path part; a leading dot alone makes no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.*[^.].*?(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def media_type(extension: Column) -> Column:
    image = F.create_map(*[F.lit(part) for pair in IMAGE_MEDIA.items() for part in pair])
    return (
        F.when(extension.isin(".md", ".markdown"), F.lit("text/markdown"))
        .when(extension == ".txt", F.lit("text/plain"))
        .when(extension.isin(*PDF_SUFFIXES), F.lit("application/pdf"))
        .otherwise(F.coalesce(F.try_element_at(image, extension), F.lit("application/octet-stream")))
    )


def data_url(extension: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), media_type(extension), F.lit(";base64,"), F.base64(content))


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def manifest_path(path: Column) -> Column:
    """Comparable form of a path: forward slashes, no leading dots or slashes."""
    return F.regexp_replace(slashed(path), "^[./]+", "")


def run_slug(label: Column) -> Column:
    words = F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-")
    slug = F.substring(F.btrim(words, F.lit("-")), 1, 48)
    return F.when(slug == "", F.lit("run")).otherwise(slug)


def run_identifier(label: Column, created: Column) -> Column:
    """``label-20260425-083000``; the session time zone has to be UTC."""
    return F.concat(run_slug(label), F.lit("-"), F.date_format(created, "yyyyMMdd-HHmmss"))


def upload_error(name: Column, size: Column) -> Column:
    """Code of the first rule an upload breaks, null when it is acceptable."""
    plain = slashed(name)
    extension = F.lower(F.regexp_extract(plain, r"^.*[^/](\.[^./]*)$", 1))
    return (
        F.when(size == 0, F.lit("empty_file"))
        .when(size > UPLOAD_LIMIT, F.lit("file_too_large"))
        .when(~extension.isin(*UPLOAD_SUFFIXES), F.lit("unsupported_file_type"))
        .when(F.contains(plain, F.lit("/")) | F.contains(plain, F.lit("..")), F.lit("unsafe_filename"))
        .when(stored_name(name) == "", F.lit("unsafe_filename"))
    )


def stored_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(slashed(name), "[^a-zA-Z0-9._-]+", "-"), F.lit("-"))


def next_command(run_id: Column, candidate_id: Column, program: str = "python -m matchloom") -> Column:
    run_dir = F.concat(F.lit("./runs/"), run_id)
    return F.concat(
        F.lit(f"{program} run --run-dir "), run_dir,
        F.lit(" --candidate-id "), candidate_id,
        F.lit(" --cv "), run_dir, F.lit("/input_files/cv"),
        F.lit(" --jd "), run_dir, F.lit("/input_files/jd"),
    )


def variant_display_name(variant_id: Column) -> Column:
    def named(label: str, prefix: str) -> Column:
        rest = F.substring(variant_id, F.lit(len(prefix) + 1), F.length(variant_id))
        return F.concat(F.lit(f"{label}（"), rest, F.lit("）"))

    return (
        F.when(F.startswith(variant_id, F.lit("variant-jd-")), named("岗位定制版本", "variant-jd-"))
        .when(F.startswith(variant_id, F.lit("variant-cluster-")), named("岗位簇版本", "variant-cluster-"))
        .otherwise(F.concat(F.lit("简历版本（"), variant_id, F.lit("）")))
    )


def variant_type_label(variant_type: Column) -> Column:
    return (
        F.when(variant_type == "cluster", F.lit("岗位簇版本"))
        .when(variant_type == "jd-specific", F.lit("岗位定制版本"))
        .otherwise(variant_type)
    )


def variant_anchor(variant_id: Column) -> Column:
    return F.concat(F.lit("variant-"), variant_id)


def byte_size(size: Column) -> Column:
    tenths = F.floor(size * F.lit(10.0) / F.lit(1024.0) + F.lit(0.5)).cast("long")
    kilobytes = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return (
        F.when(size.isNull() | (size <= 0), F.lit("--"))
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .otherwise(F.concat(kilobytes, F.lit(" KB")))
    )
