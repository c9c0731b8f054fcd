"""A log of remote replies: calls are written down while they run and looked up before any is made.

A request is named by a hash of its key, prompt and endpoint. Tasks make a bounded number of calls at once
and write every finished group of them as a file of the log; an attempt that follows a failed one reads
what its predecessor wrote and goes on behind it, so a key that got its reply is never asked twice. A new
job asks only for what the log has no reply to; errors are asked for again. File names tell how many calls
a file holds, so progress is read from names and a last line, not from replies.
"""

from __future__ import annotations

import atexit
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import remove, shared_folder
from matchloom.sources.paths import absolute, exists, literal, opened_system, opens_in_tasks

SCHEMA = "request STRING, reply STRING, error_type STRING, error_message STRING, at DOUBLE"
#: Calls that a task has open at once, and calls of one log file.
CALLS_AT_ONCE, CALLS_PER_FILE = 4, 16
POLL_SECONDS = 0.2

Reply = tuple[str | None, str | None, str | None]
Progress = Callable[[dict[str, Any]], None]


def new_log(spark: SparkSession) -> str:
    """A log for the time of the program."""
    path = f"{shared_folder(spark)}/replies-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def _files(folder: str) -> list[tuple[str, Any]]:
    from pyarrow import fs

    system, place = opened_system(folder)
    found = system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    return [(f.base_name, f) for f in sorted(found, key=lambda f: f.mtime_ns or 0) if f.base_name.startswith("part-")]


def _lines(folder: str, info: Any) -> list[dict[str, Any]]:
    system, _ = opened_system(folder)
    with system.open_input_stream(info.path) as stream:
        return [json.loads(line) for line in stream.read().decode("utf-8").splitlines()]


def write_group(folder: str, part: int, lines: list[dict[str, Any]], count: int, ok: int, millis: int) -> None:
    """One file of the log, standing for ``count`` items; it gets its name only when it is whole."""
    system, place = opened_system(folder)
    system.create_dir(place, recursive=True)
    name = f"{part:06d}-{uuid.uuid4().hex}-{count}-{ok}-{millis}.json"
    with system.open_output_stream(f"{place}/.{name}") as out:
        out.write("".join(json.dumps(line, ensure_ascii=False) + "\n" for line in lines).encode("utf-8"))
    system.move(f"{place}/.{name}", f"{place}/part-{name}")


def logged_calls(
    batches: Iterator[pd.DataFrame], ask: Callable[[str], Reply], folder: str, part: int
) -> Iterator[pd.DataFrame]:
    """Make the calls of one task (request, prompt, label), but for those an earlier attempt has made."""
    mine = f"part-{part:06d}-"
    done = {line["request"] for name, info in _files(folder) if name.startswith(mine) for line in _lines(folder, info)}
    made = len(done)

    def called(row: tuple[str, str, str]) -> dict[str, Any]:
        request, prompt, label = row
        reply, kind, message = ask(prompt)
        answer = {"request": request, "reply": reply, "error_type": kind, "error_message": message, "at": time.time()}
        return answer | {"label": label}

    with ThreadPoolExecutor(CALLS_AT_ONCE) as pool:
        for batch in batches:
            rows = [row for row in zip(batch["request"], batch["prompt"], batch["label"], strict=True) if row[0] not in done]
            for start in range(0, len(rows), CALLS_PER_FILE):
                began = time.perf_counter()
                group = list(pool.map(called, rows[start : start + CALLS_PER_FILE]))
                ok = sum(line["error_type"] is None for line in group)
                write_group(folder, part, group, len(group), ok, int((time.perf_counter() - began) * 1000))
                made += len(group)
    yield pd.DataFrame({"calls": [made]})


def logged(spark: SparkSession, log: str) -> DataFrame:
    """What the log knows of every request: its latest reply, or its latest error if it has no reply."""
    if not exists(log):
        return spark.createDataFrame([], SCHEMA).drop("at")
    lines = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(literal(absolute(log)))
    answer = F.struct("reply", "error_type", "error_message")
    best = F.max_by(answer, F.struct(F.col("error_type").isNull(), "at"))
    return lines.groupBy("request").agg(best.alias("_answer")).select("request", "_answer.*")


def replies(
    rows: DataFrame,
    key: list[str],
    prompt: Column,
    endpoint_name: str,
    ask: Callable[[str], Reply],
    log: str | None = None,
    label: Column | None = None,
) -> DataFrame:
    """A reply for each row: (key, reply, error_type, error_message), through the log."""
    spark = rows.sparkSession
    log = log or new_log(spark)
    if not opens_in_tasks(log):
        raise ValueError(f"tasks cannot write the reply log `{log}`; name a folder on a file system that they open themselves")
    name = F.sha2(F.to_json(F.struct(*key, prompt.alias("_prompt"), F.lit(endpoint_name).alias("_endpoint"))), 256)
    text = F.lit("") if label is None else label
    told = rows.select(*key, name.alias("request"), prompt.alias("prompt"), text.alias("label"))
    before = logged(spark, log).where("error_type IS NULL").select("request")
    asked = told.select("request", "prompt", "label").join(before, "request", "left_anti")
    folder = f"{log}/job-{time.time_ns()}-{uuid.uuid4().hex}"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from logged_calls(batches, ask, folder, TaskContext.get().partitionId())

    asked.mapInPandas(call, "calls BIGINT").agg(F.sum("calls")).collect()
    return told.select(*key, "request").join(logged(spark, log), "request", "left").drop("request")


def noted(rows: DataFrame, folder: str) -> DataFrame:
    """Rows as they are, with a note in ``folder`` for every batch of them that a task has finished.

    Only the pair's names and its outcome go to Python.
    """
    def note(jds: pa.Array, variants: pa.Array, assessed: pa.Array) -> pa.Array:
        told = assessed.to_pylist()
        if told:
            label = json.dumps({"jd_id": jds[-1].as_py(), "variant_id": variants[-1].as_py()})
            line = {"label": label, "error_type": None if told[-1] else "fallback"}
            write_group(folder, TaskContext.get().partitionId(), [line], len(told), sum(map(bool, told)), 0)
        return pa.array([True] * len(told), pa.bool_())

    mark = F.arrow_udf(note, "boolean").asNondeterministic()
    return rows.withColumn("_noted", mark("jd_id", "variant_id", "assessed"))


class Watch:
    """Tells ``progress`` about new files of a log while a job writes them, and about the rest at the end."""

    def __init__(self, folder: str, total: int, progress: Progress) -> None:
        self._folder, self._total, self._progress = folder, total, progress
        self._seen: set[str] = set()
        self._completed, self._last = 0, time.perf_counter()
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _tell(self) -> None:
        for name, info in _files(self._folder):
            if name in self._seen:
                continue
            self._seen.add(name)
            count, ok, millis = map(int, name.removesuffix(".json").split("-")[-3:])
            last = _lines(self._folder, info)[-1]
            label = json.loads(last.get("label") or "{}")
            now = time.perf_counter()
            spent, self._last = int((now - self._last) * 1000), now
            self._completed += count
            self._progress(
                {
                    "completed": self._completed,
                    "total": self._total,
                    "jd_id": label.get("jd_id", ""),
                    "variant_id": label.get("variant_id", ""),
                    "status": "ok" if last.get("error_type") is None else "fallback",
                    "duration_ms": millis or spent,
                    "ok": ok,
                    "fallback": count - ok,
                }
            )

    def _run(self) -> None:
        while not self._over.wait(POLL_SECONDS):
            self._tell()

    def __enter__(self) -> Watch:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._over.set()
        self._thread.join()
        self._tell()
