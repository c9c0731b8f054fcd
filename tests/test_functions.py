"""Expressions against plain Python on the cases that are easy to get silently wrong."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import language, naming, scoring
from matchloom.functions import text as tx
from matchloom.operators import parse


def values(spark, items, kind, *columns):
    rows = [(at, item) for at, item in enumerate(items)]
    frame = spark.createDataFrame(rows, f"at INT, x {kind}").select("at", *[c.alias(f"c{i}") for i, c in enumerate(columns)])
    found = [tuple(row)[1:] for row in sorted(frame.collect(), key=lambda row: row["at"])]
    return [row[0] for row in found] if len(columns) == 1 else found


def test_two_decimal_rounding_is_binary_exact(spark):
    numbers = [k / 1000 for k in range(0, 1000)] + [k / 200 for k in range(0, 200)] + [0.1 + 0.2, 0.615, 0.575, 1.005, 2.675]
    assert values(spark, numbers, "DOUBLE", scoring.round2(F.col("x"))) == [round(x, 2) for x in numbers]


def test_bounded_and_ratio(spark):
    assert values(spark, [-1.0, 0.5, 1.0], "DOUBLE", scoring.bounded(F.col("x"))) == [0.0, 0.5, 0.99]
    assert values(spark, [0, 1, 3], "INT", scoring.ratio(F.lit(1), F.col("x"))) == [0.0, 0.99, 0.33]


def test_zero_counts_as_missing_for_ranking(spark):
    assert values(spark, [0.0, 0.4, None], "DOUBLE", scoring.score_or_else(F.col("x"), F.lit(0.7))) == [0.7, 0.4, 0.7]


def test_safe_score(spark):
    texts = ["0.876", "-3", "7", "NaN", "x", "", None]
    assert values(spark, texts, "STRING", scoring.safe_score(F.col("x"))) == [0.88, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0]


def test_safe_texts(spark):
    texts = ['["a", " ", 1, true, null]', '{"a": 1}', "[", None, '"text"', "[]"]
    assert values(spark, texts, "STRING", scoring.safe_texts(F.col("x"))) == [["a", "1", "True", "None"], [], [], [], [], []]


TEXTS = [
    "  plain ", " nbsp　", "İstanbul-Ünïcode", "tab\tand\nline", "", "\x1c\x1fx\x85", "a-b_c  d", "中文 only", "x y",
]


def test_strip_and_normalise_match_python(spark):
    expected = [
        (t.strip(), re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]+", " ", t.lower())).strip(), not t.strip()) for t in TEXTS
    ]
    x = F.col("x")
    assert values(spark, TEXTS, "STRING", tx.strip(x), tx.normalised(x), tx.is_blank(x)) == expected


BULLET_TEXTS = [
    "- one\n  -- two -\nthree\n-\n\t- four",
    "Body:\n- a\r\n- b\x0b- c",
    "no bullets",
    "-",
    "- x - y  - z- ",
]


def python_bullets(text):
    return [line.strip("- ").strip() for line in text.splitlines() if line.strip().startswith("-")]


def test_bullets_match_python(spark):
    assert values(spark, BULLET_TEXTS, "STRING", tx.bullets(F.col("x"))) == [python_bullets(t) for t in BULLET_TEXTS]


@settings(max_examples=5, deadline=None)
@given(batch=st.lists(st.text(alphabet="-ab \n\r\t\x0b\x1c  :", max_size=30), min_size=40, max_size=40))
def test_line_helpers_match_python_on_random_text(spark, batch):
    expected = [(t.strip(), python_bullets(t)) for t in batch]
    assert values(spark, batch, "STRING", tx.strip(F.col("x")), tx.bullets(F.col("x"))) == expected


def test_headers_and_body(spark):
    block = "intro\n  Title: A: b \nTitle: second\nCompany:\nBody:\n- one\nBody: x\n- two"
    x = F.col("x")
    columns = (tx.header(x, "Title"), tx.header(x, "Company"), tx.header(x, "Level"), tx.body_bullets(x))
    assert values(spark, [block], "STRING", *columns) == [("A: b", "", "", ["one", "two"])]
    assert values(spark, ["Title: t\n- not body"], "STRING", tx.body_bullets(x)) == [[]]


def test_cluster_slug(spark):
    found = values(spark, ["Senior Sales Manager", "", "！"], "STRING", parse.cluster(F.col("x"), tx.no_texts()))
    assert found == ["senior-sales-manager", "general", "general"]
    assert values(spark, [""], "STRING", parse.cluster(F.col("x"), tx.texts("Own the GTM plan now"))) == ["own-the-gtm-plan"]


def test_keyword_limit_and_default(spark):
    texts = ["evaluation ranking python prompt product automation", "nothing here", "an llm tool"]
    assert values(spark, texts, "STRING", parse.keywords(F.col("x"))) == [
        ["evaluation", "ranking", "python", "prompt engineering", "product collaboration"],
        ["python", "ai workflows"],
        ["llm"],
    ]


def test_empty_needle_is_always_found(spark):
    found = values(spark, ["中文", "abc"], "STRING", F.contains(F.lit("some text"), tx.normalised(F.col("x"))))
    assert found == [True, False]


def test_blank_keyword_stops(spark):
    with pytest.raises(Exception, match="keyword without a first word"):
        values(spark, [" "], "STRING", tx.first_token(F.col("x")))


def test_language_checks(spark):
    texts = ["中文", "", "abc", "中a", "中ab", "中文ab cd"]
    assert values(spark, texts, "STRING", language.chinese_dominant(F.col("x"))) == [True, False, False, True, False, False]
    names = ["", "gpt-5.4", "ab c", "two words", "中文", "[x]#1"]
    assert values(spark, names, "STRING", language.identifier_like(F.col("x"))) == [True, True, True, False, False, True]


def test_run_ids_and_names(spark):
    labels = ["April upload", "--", "A" * 60]
    moment = F.lit("2026-04-25 08:30:00").cast("timestamp_ntz")
    assert values(spark, labels, "STRING", naming.run_identifier(F.col("x"), moment)) == [
        "april-upload-20260425-083000", "run-20260425-083000", "a" * 48 + "-20260425-083000",
    ]
    assert values(spark, ["my cv (1).md", "///", "ok.pdf"], "STRING", naming.stored_name(F.col("x"))) == [
        "my-cv-1-.md", "", "ok.pdf",
    ]
    assert values(spark, ["..\\a/b.md", "./x", "/abs"], "STRING", naming.manifest_path(F.col("x"))) == ["a/b.md", "x", "abs"]


def test_upload_errors(spark):
    rows = [("a.md", 1), ("a.md", 0), ("a.md", naming.UPLOAD_LIMIT + 1), ("a.exe", 1), ("../a.md", 1), ("a", 1), ("。.md", 1)]
    frame = spark.createDataFrame(rows, "name STRING, size BIGINT")
    found = [row[0] for row in frame.select(naming.upload_error(F.col("name"), F.col("size"))).collect()]
    assert found == [None, "empty_file", "file_too_large", "unsupported_file_type", "unsafe_filename", "unsupported_file_type", None]


def test_display(spark):
    assert values(spark, [0, 500, 1280, 2048, None], "BIGINT", naming.byte_size(F.col("x"))) == [
        "--", "500 B", "1.3 KB", "2.0 KB", "--",
    ]
    assert values(spark, [0.005, 0.815, 2.0, -1.0], "DOUBLE", scoring.percent(F.col("x"))) == [1, 82, 100, 0]
