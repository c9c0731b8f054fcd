"""A sink for ordered artifacts: text rows become a folder of ordered parts, or one file on request.

Tasks write parts into a staging folder beside the artifact and report them; only when all are there does
the commit drop what failed attempts left and move the rest into place. An aborted job leaves the old
artifact as it was. The form never depends on size: a folder keeps every task's part, and one file is
written by one task, which streams the rows it sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from matchloom.sources.paths import absolute, opened_system

#: Forms of an artifact.
FILE, FOLDER = "file", "folder"


@dataclass
class Part(WriterCommitMessage):
    """A part that a task has finished."""

    name: str


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, path: str, form: str, opening: str, between: str, closing: str) -> None:
        self.path, self.form = path, form
        self.opening, self.between, self.closing = opening, between, closing
        self.staging = f"{path}.writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        """One part, under a name of its own for every attempt."""
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.json"
        system, folder = opened_system(self.staging)
        system.create_dir(folder, recursive=True)
        single, started = self.form == FILE, False
        with system.open_output_stream(f"{folder}/{name}") as out:
            if single:
                out.write(self.opening.encode())
            for batch in batches:
                texts = batch.column(0).to_pylist()
                if texts and single:
                    out.write(((self.between if started else "") + self.between.join(texts)).encode())
                elif texts:
                    out.write("".join(f"{text}\n" for text in texts).encode())
                started |= bool(texts)
            if single:
                out.write(self.closing.encode())
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, target = opened_system(self.path)
        _, folder = opened_system(self.staging)
        names = {message.name for message in messages if message is not None}
        if self.form == FILE and len(names) > 1:
            raise ValueError(f"{len(names)} tasks wrote parts of the single file `{self.path}`")
        system.create_dir(folder, recursive=True)
        if self.form == FILE and not names:
            names = {"part-empty.json"}
            with system.open_output_stream(f"{folder}/part-empty.json") as out:
                out.write((self.opening + self.closing).encode())
        for left in system.get_file_info(fs.FileSelector(folder)):
            if left.base_name not in names:
                system.delete_file(left.path)
        kind = system.get_file_info(target).type
        if kind == fs.FileType.Directory:
            system.delete_dir(target)
        elif kind == fs.FileType.File:
            system.delete_file(target)
        if self.form == FILE:
            system.move(f"{folder}/{names.pop()}", target)
            system.delete_dir(folder)
        else:
            system.move(folder, target)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, folder = opened_system(self.staging)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class ArtifactSink(DataSource):
    """``df.write.format("matchloom_artifact")`` for one text column; see ``write_artifact``."""

    @classmethod
    def name(cls) -> str:
        return "matchloom_artifact"

    def schema(self) -> str:
        return "value STRING"

    def writer(self, schema: object, overwrite: bool) -> ArtifactWriter:
        given = self.options
        return ArtifactWriter(given["path"], given["form"], *(given.get(k, "") for k in ("opening", "between", "closing")))


def write_artifact(
    rows: DataFrame, value: Column, order: list[Column | str], path: str, form: str = FOLDER,
    opening: str = "", between: str = "\n", closing: str = "",
) -> str:
    """Write ``value`` of the rows by ``order``: lines of ordered parts, or one file in between the given texts."""
    if form not in (FILE, FOLDER):
        raise ValueError(f"An artifact is a `{FILE}` or a `{FOLDER}`, not `{form}`.")
    rows.sparkSession.dataSource.register(ArtifactSink)
    if form == FILE:
        rows = rows.repartition(1)
        ordered = rows.sortWithinPartitions(*order) if order else rows
    else:
        ordered = rows.orderBy(*order) if order else rows
    writer = ordered.select(value.alias("value")).write.format(ArtifactSink.name()).mode("append")
    told = {"path": absolute(path), "form": form, "opening": opening, "between": between, "closing": closing}
    writer.options(**told).save()
    return path


def pretty(value: Column, indent: str = "  ") -> Column:
    """A record as indented JSON; line breaks inside its texts are escaped, so only its own lines move."""
    text = F.to_json(value, {"ignoreNullFields": "false", "pretty": "true"})
    return F.concat(F.lit(indent), F.regexp_replace(text, "\n", "\n" + indent))
