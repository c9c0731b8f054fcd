"""The pipeline's stages on rows made for them, and the registered queries against each other."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("matchloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from matchloom.llm import near_dup, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.cache()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out[name] = docs
    yield out
    for rows in out.values():  # other tests read the same tables, and their plans would show these
        rows.unpersist()


def ids(rows):
    return {r.doc_id for r in rows.select("doc_id").collect()}


def test_stages_keep_the_columns_of_documents(stages):
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        assert stages[name].columns == stages["documents"].columns


def test_each_stage_drops_what_its_operator_finds(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = queries.toxicity_model(stages["documents"], labels)
    scores = toxicity.scored(stages["documents"], model)
    assert ids(stages["toxicity"]) == ids(scores.where(F.col("score") < toxicity.THRESHOLD))
    assert ids(stages["line_dedup"]) == ids(stages["toxicity"])
    found = near_dup.near_duplicates(stages["line_dedup"])
    assert ids(stages["near_dedup"]) == ids(found.where("kept"))
    assert ids(stages["decontamination"]) <= ids(stages["near_dedup"])
    assert stages["byte_bpe"].where("NOT decodes_back").count() == 0
    assert ids(stages["byte_bpe"]) == ids(stages["decontamination"])


def test_stages_take_empty_tables_and_nulls(spark, stages):
    docs = stages["documents"]
    nulls = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).limit(2).union(docs.limit(3))
    for rows, least in ((docs.limit(0), 0), (nulls.withColumn("toxicity", F.lit(1)), 2)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        assert rows.count() >= least


def test_run_gives_the_last_stage(spark, stages):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(stages["byte_bpe"])


def test_copies_do_not_lose_their_lines_as_boilerplate(spark):
    rng = random.Random(1)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    exact, near = [line() for _ in range(3)], [line() for _ in range(4)]
    texts = [["menu", *exact]] * 20 + [["menu", *near[:3], near[3] + f" v{i}"] for i in range(20)]
    texts += [["menu", line(), line()] for _ in range(18)] + [["menu"]] * 2
    rows = [(i, "\n".join(t), "en", "src", 1) for i, t in enumerate(texts)]  # two groups of a third each
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_boilerplate(spark, docs, SF).cache()
    assert {r.doc_id: r.text for r in kept.collect()} == {
        i: "menu" if t == ["menu"] else "\n".join(t[1:]) for i, t in enumerate(texts)
    }
    assert ids(corpus_pipeline.drop_near_duplicates(spark, kept, SF)) == {0, 20, *range(40, 59)}
    kept.unpersist()
