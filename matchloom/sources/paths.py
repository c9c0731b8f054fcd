"""Paths as Spark and Hadoop want them."""

from __future__ import annotations

import os
import re
from urllib.parse import quote

from pyspark.sql import SparkSession


def absolute(path: str) -> str:
    """Path with a scheme; a local one is made absolute and free of links first."""
    return path if "://" in path else f"file://{os.path.realpath(path)}"


def literal(path: str) -> str:
    """Path whose pattern characters, such as brackets, stand for themselves in a Spark read."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def as_uri(path: str) -> str:
    """Hadoop path text as a URI other libraries parse: an authority part, and escaped characters."""
    scheme, authority, place = re.match(r"^([^:/]+):(//[^/]*)?(/.*)$", path).groups()
    return f"{scheme}:{authority or '//'}{quote(place)}"


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(absolute(path))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def opened_system(path: str):
    """The file system of ``path`` as drivers and tasks open it without a JVM, and the place on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(as_uri(absolute(path)))


def opens_in_tasks(path: str) -> bool:
    """Whether tasks reach the file system of ``path`` by themselves; others are read through Hadoop."""
    import pyarrow

    try:
        opened_system(path)
    except (pyarrow.ArrowInvalid, pyarrow.ArrowNotImplementedError, OSError):
        return False
    return True


def kind(path: str) -> str | None:
    """``file`` or ``folder``, or None where there is nothing."""
    from pyarrow import fs

    system, place = opened_system(path)
    return {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(system.get_file_info(place).type)


def exists(path: str) -> bool:
    return kind(path) is not None


def is_folder(path: str) -> bool:
    return kind(path) == "folder"


def read_text(path: str) -> str:
    """A small file, such as a configuration; FileNotFoundError where there is none."""
    system, place = opened_system(path)
    with system.open_input_stream(place) as stream:
        return stream.read().decode("utf-8")


def write_bytes(path: str, data: bytes) -> str:
    """Write a small file, with the folders above it."""
    system, place = opened_system(path)
    system.create_dir(place.rpartition("/")[0] or "/", recursive=True)
    with system.open_output_stream(place) as stream:
        stream.write(data)
    return path


def write_text(path: str, text: str) -> str:
    return write_bytes(path, text.encode("utf-8"))
