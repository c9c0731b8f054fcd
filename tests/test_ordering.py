"""Positions and edges of groups, with one group holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import candidate, parse, ranking, variants
from matchloom.operators.ordering import first_per_key, last_per_key, numbered, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    chance = random.Random(7)
    rows = [("hot" if chance.random() < 0.7 else f"g{chance.randrange(40)}", n, chance.randrange(5)) for n in range(6000)]
    return rows, spark.createDataFrame(rows, "g STRING, n BIGINT, v BIGINT").repartition(5)


@pytest.mark.parametrize("carry", [False, True])
def test_running_total_matches_brute_force(skewed, carry):
    rows, frame = skewed
    found = running_total(frame, ["g"], ["n"], [F.col("v"), F.col("n")], F.col("v"), "total", carry)
    assert set(found.columns) == {"g", "n", "v", "total"}
    sums, expected = {}, {}
    for group, n, v in sorted(rows, key=lambda row: (row[0], row[2], row[1])):
        sums[group] = sums.get(group, 0) + v
        expected[n] = sums[group]
    assert {row["n"]: row["total"] for row in found.collect()} == expected


def test_hot_group_is_cut_into_slices(spark, skewed):
    _, frame = skewed
    sizes = (
        frame.repartitionByRange(8, "g", "v", "n").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    )
    assert max(row["count"] for row in sizes) < 6000 * 0.4


def test_numbered_descending(skewed):
    rows, frame = skewed
    found = numbered(frame, ["g"], ["n"], [-F.col("v"), F.col("n")], "rank")
    places, expected = {}, {}
    for group, n, _ in sorted(rows, key=lambda row: (row[0], -row[2], row[1])):
        places[group] = places.get(group, 0) + 1
        expected[n] = places[group]
    assert {row["n"]: row["rank"] for row in found.collect()} == expected


def test_edges_per_key(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k STRING, at INT, v STRING")
    assert {(r["k"], r["v"]) for r in last_per_key(frame, ["k"], "at").collect()} == {("a", "y"), ("b", "z")}
    assert {(r["k"], r["v"]) for r in first_per_key(frame, ["k"], "at").collect()} == {("a", "x"), ("b", "z")}


def test_block_ids_run_on_over_inputs(spark):
    inputs = spark.createDataFrame(
        [
            ("r", 1, "file", "a", "=== JD ===\nTitle: A\n=== JD ===\n \n=== JD ===\nTitle: B"),
            ("r", 2, "file", "b", "Title: C"),
            ("s", 1, "file", "c", "   "),
            ("s", 2, "file", "d", "Title: D"),
        ],
        "run_id STRING, input_ord BIGINT, source_type STRING, source_value STRING, content STRING",
    )
    found = {(r["run_id"], r["jd_id"], r["block"]) for r in parse.number_blocks(inputs).collect()}
    assert found == {("r", "jd-001", "Title: A"), ("r", "jd-002", "Title: B"), ("r", "jd-003", "Title: C"), ("s", "jd-001", "Title: D")}


def test_text_pieces_and_joined_text_agree(spark):
    documents = spark.createDataFrame(
        [("r", 1, "a.md", " one "), ("r", 2, "b.md", "\n"), ("r", 3, "c.md", "two\nlines")],
        "run_id STRING, input_ord BIGINT, source_value STRING, text STRING",
    )
    whole = candidate.joined_text(documents).head()["resume_text"]
    assert whole == "Source: a.md\none\n\nSource: c.md\ntwo\nlines"
    for piece in candidate.text_pieces(documents).collect():
        assert whole[piece["start_char"]:].startswith(piece["piece"])


def test_profiles_need_no_whole_text(spark):
    rows = [("r", i, f"{i}.md", f"\n- bullet {i % 7}\n  -- python tool {i} - \nplain\u2028- after a break\n") for i in range(60)]
    rows += [("s", 1, "a.md", " "), ("s", 2, "- b.md", "no bullet"), ("t", 1, "x.md", "- one")]
    documents = spark.createDataFrame(rows, "run_id STRING, input_ord BIGINT, source_value STRING, text STRING").repartition(7)
    people = [F.lit("c").alias("candidate_id"), F.lit("p").alias("base_resume_path")]
    whole = candidate.candidate_profiles(candidate.joined_text(documents).select("*", *people))
    parts = candidate.candidate_profiles(candidate.experiences(documents).select("*", *people))
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert parts.filter("run_id = 's'").head()["experiences"] == []
    assert len(parts.filter("run_id = 'r'").head()["experiences"]) == 180


def test_relevant_variants_by_containment(spark):
    jds = spark.createDataFrame([("r", 0, "jd-001"), ("r", 1, "jd-002")], "run_id STRING, jd_index BIGINT, jd_id STRING")
    made = spark.createDataFrame(
        [("r", 0, "v-a", ["jd-001", "jd-001"]), ("r", 1, "v-b", ["jd-002", "jd-001"]), ("r", 2, "v-c", ["jd-009"])],
        "run_id STRING, variant_ord BIGINT, variant_id STRING, target_jd_ids ARRAY<STRING>",
    )
    rows = variants.with_variant_index(variants.work_items(jds, made)).collect()
    assert {(r["jd_id"], r["variant_id"], r["variant_index"]) for r in rows} == {
        ("jd-001", "v-a", 0), ("jd-001", "v-b", 1), ("jd-002", "v-b", 0),
    }


CARD = "run_id STRING, jd_index BIGINT, jd_id STRING, variant_ord BIGINT, variant_id STRING, final_overall_score DOUBLE, overall_score DOUBLE, fit_score DOUBLE, evidence_score DOUBLE, gap_risk_score DOUBLE"


def test_best_and_rank_with_ties_zero_and_duplicates(spark):
    cards = spark.createDataFrame(
        [
            ("r", 0, "a", 0, "v0", 0.5, 0.1, 0.5, 0.5, 0.5),
            ("r", 0, "a", 1, "v1", 0.5, 0.1, 0.5, 0.5, 0.5),  # tie: the earlier one stays
            ("r", 1, "b", 2, "v2", 0.0, 0.9, 0.5, 0.5, 0.5),  # zero counts as missing
            ("r", 2, "c", 3, "v3", 0.5, 0.1, 0.5, 0.5, 0.4),  # less risk wins
            ("r", 3, "a", 4, "v4", 0.4, 0.1, 0.9, 0.9, 0.1),  # second document with the same id
            ("r", 4, "d", 5, "v5", 0.5, 0.1, 0.5, 0.5, 0.5),
        ],
        CARD,
    )
    ranked = ranking.priority_ranks(ranking.best_per_jd(cards, ["variant_id"]))
    assert {(r["jd_id"], r["variant_id"], r["priority_rank"]) for r in ranked.collect()} == {
        ("b", "v2", 1), ("c", "v3", 2), ("a", "v0", 3), ("d", "v5", 4),
    }
