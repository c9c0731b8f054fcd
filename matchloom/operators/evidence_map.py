"""The evidence map of a run as rows: one per top-level part, and one per document below ``jds``.

Rows are (run_id, place, part, name, value): ``value`` is JSON, ``name`` a document's id or null. The map of
the built-in analyzer, one that a remote analyzer returned and one that a user edited are all such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import parse

DOCUMENTS = "jds"
SCHEMA = "run_id STRING, place BIGINT, part STRING, name STRING, value STRING"
_OBJECT = "map<string,variant>"


def made(people: DataFrame, documents: DataFrame) -> DataFrame:
    """The map of the built-in analyzer: what backs the candidate, the risks, and each document's evidence."""
    none = F.lit(None).cast("string")
    person = F.to_json(F.struct("core_claims", "verified_evidence", "missing_evidence_areas"))
    parts = F.array(
        F.struct(F.lit(-2).cast("long").alias("place"), F.lit("candidate").alias("part"), none.alias("name"), person.alias("value")),
        F.struct(F.lit(-1).cast("long").alias("place"), F.lit("risks").alias("part"), none.alias("name"),
                 F.to_json("missing_evidence_areas").alias("value")),
    )
    shared = people.select("run_id", F.inline(parts))
    own = parse.jd_evidence(documents).select(
        "run_id",
        F.col("jd_index").cast("long").alias("place"),
        F.lit(DOCUMENTS).alias("part"),
        F.col("jd_id").alias("name"),
        F.to_json(F.struct("must_have", "source_snippets", "risk_signals")).alias("value"),
    )
    return shared.unionByName(own)


def parsed(maps: DataFrame) -> DataFrame:
    """Rows out of whole maps (run_id, value); what is no JSON object has none."""
    top = maps.select("run_id", F.posexplode(F.from_json("value", _OBJECT)).alias("pos", "part", "entry"))
    top = top.select("run_id", "pos", "part", F.to_json("entry").alias("value"))
    below = F.from_json("value", _OBJECT)
    is_documents = (F.col("part") == DOCUMENTS) & F.startswith(F.col("value"), F.lit("{"))
    shared = top.filter(~is_documents).select(
        "run_id", (F.col("pos") - 1_000_000).cast("long").alias("place"), "part", F.lit(None).cast("string").alias("name"), "value"
    )
    own = top.filter(is_documents).select("run_id", "part", F.posexplode(below).alias("pos", "name", "entry")).select(
        "run_id", F.col("pos").cast("long").alias("place"), "part", "name", F.to_json("entry").alias("value")
    )
    return shared.unionByName(own)


def entry(name: Column, value: Column) -> Column:
    """``"name": value`` of a JSON object."""
    quoted = F.to_json(F.array(name))
    return F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(": "), value)


def shared_json(rows: DataFrame) -> DataFrame:
    """Per run the parts that belong to no document (run_id, shared_json), as the inside of an object."""
    items = F.array_sort(F.collect_list(F.struct("place", entry(F.col("part"), F.col("value")).alias("text"))))
    inside = F.array_join(F.transform(items, lambda item: item["text"]), ", ")
    return rows.filter("name IS NULL").groupBy("run_id").agg(inside.alias("shared_json"))


def own_json(rows: DataFrame) -> DataFrame:
    """Per document its entry (run_id, jd_id, own_json); of repeated ids the last counts."""
    named = rows.filter("name IS NOT NULL").groupBy("run_id", F.col("name").alias("jd_id"))
    return named.agg(F.max_by("value", "place").alias("own_json"))


def told(shared: Column, jd_id: Column, own: Column) -> Column:
    """The map as one document's judge reads it: all shared parts and the document's own entry."""
    mine = F.concat(F.lit(f'"{DOCUMENTS}": {{'), entry(jd_id, own), F.lit("}"))
    return F.concat(F.lit("{"), F.concat_ws(", ", F.nullif(shared, F.lit("")), mine), F.lit("}"))


def pieces(rows: DataFrame) -> DataFrame:
    """Ordered pieces of the map's JSON text (place, piece), for a file of any size."""
    named = F.col("name").isNotNull()
    first = rows.agg(F.min(F.when(named, F.col("place")))).scalar()
    # A list of documents keeps its name; documents by id then stand under another one.
    taken = rows.agg(F.coalesce(F.max((F.col("part") == DOCUMENTS) & ~named), F.lit(False))).scalar()
    opening = F.when(taken, F.lit('"documents": {')).otherwise(F.lit(f'"{DOCUMENTS}": {{'))
    comma = F.when(F.col("place") > first, F.lit(",\n")).otherwise(F.lit("\n"))
    body = rows.select(
        F.when(named, F.lit(3)).otherwise(F.lit(1)).alias("step"),
        "place",
        F.when(named, F.concat(comma, entry(F.col("name"), F.col("value"))))
        .otherwise(F.concat(entry(F.col("part"), F.col("value")), F.lit(",\n")))
        .alias("piece"),
    )
    zero, one = F.lit(0).cast("long").alias("place"), rows.sparkSession.range(1)
    edges = one.select(F.lit(2).alias("step"), zero, opening.alias("piece")).unionByName(
        one.select(F.lit(4).alias("step"), zero, F.lit("}").alias("piece"))
    )
    return body.unionByName(edges)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
