"""Registered queries of the operators with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, decontaminate, fill_middle, line_dedup, near_dup, pii, pitman_yor, sql, storage, substring_dedup, token_files, toxicity,
    url_rules, vector_codes, vector_search,
)

#: Where the vocabulary files are; a caller may name others.
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")
#: Appended to each document in token files.
END_ID = 2
#: Host rules of the url filter, as (verdict, host and path).
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Patterns of the url filter: advertising, betting, junk shops, adult pages, and pages without prose of their own.
URL_PATTERNS = [
    "||ads-track.", "||ads.", "||adserver.", "||doubleclick.", "||tracking.", "/adserver/", "/banner/ads/", "/pixel.gif",
    "||free-bets.", "||casino-win.", "||casino.", "||poker.", "||betting.", "/sports-betting/",
    "||cheap-pills.", "||pharmacy-online.", "||spam-farm.", "||link-farm.", "/buy-now/*/checkout^",
    "||adult-x.", "||xxx.", "||porn.", "/adult/videos/",
    "/login^", "/signin^", "/cart^", "/checkout^", "/wp-login.php", "^replytocom=", "^sessionid=", "^phpsessid=",
    "/search^*^q=", "/calendar/*/month/", "/print^|", "/feed/rss^",
    "@@||free-bets.*/help/responsible-gaming^", "@@||casino.*/history/", "@@/login/help^",
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return near_dup.near_duplicates(_table(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digests(pii.with_personal_data(_table(spark, folder, "documents").select("doc_id", "text")))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, read back."""
    path = storage.new_folder(spark)
    token_files.write(_table(spark, folder, "documents"), path, TOKENIZER_FILE, END_ID)
    return token_files.read(spark, path, token_files.crc32, "bigint").withColumnRenamed("value", "ids_crc32")


def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best vectors of every 50th."""
    return vector_search.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in all documents."""
    rows = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded and decoded again."""
    rows = bpe.encoded(_table(spark, folder, "documents").select("doc_id", "text"), RANK_FILE, PATTERN)
    return bpe.digests(bpe.decoded(rows.select("doc_id", "ids"), RANK_FILE))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without passages that an earlier one has."""
    rows = substring_dedup.without_repeats(_table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Text lines of all pages without the boilerplate of their host."""
    pages = _table(spark, folder, "pages").select(
        "page_id", line_dedup.host(F.col("url")).alias("host"), line_dedup.page_text(F.col("html")).alias("text")
    )
    return line_dedup.without_boilerplate(pages, F.col("host"))


def toxicity_model(documents: DataFrame, labels: DataFrame) -> list[tuple[int, float]]:
    """Fitted on labelled documents outside the held-out fold."""
    known = labels.where(toxicity.remainder(F.col("doc_id"), 4) != 2)
    return toxicity.fit(documents.select("doc_id", "text"), known.select("doc_id", F.col("toxic").alias("label")))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents."""
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    rows = toxicity.scored(documents, toxicity_model(documents, _table(spark, folder, "labels")))
    return rows.select(
        "doc_id",
        (toxicity.remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of all documents."""
    rows = pitman_yor.scored(_table(spark, folder, "documents"), toxicity.remainder(F.col("doc_id"), 10) != 0)
    return rows.withColumn("held_out", ~F.col("trained")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors as product codes, with their errors and those of their label."""
    rows = _table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    kept, width = vector_codes.integer_vectors(rows, "embedding")
    books = vector_codes.train(kept, "vec_id", "embedding", width)
    coded = storage.stored(vector_codes.encoded(kept, "embedding", books))
    # Written first, so that its size decides how the join is done, and a label of many rows moves none of them.
    sums = storage.stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id",
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        F.sha2(F.lit(vector_codes.books_text(books)).cast("binary"), 256).alias("codebooks_sha256"),
    )


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return url_rules.judged(_table(spark, folder, "pages").select("page_id", "url"), "url", HOST_RULES, URL_PATTERNS).drop("url")


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents stored as frames, transformed and restored."""
    store = storage.stored(fill_middle.framed(_table(spark, folder, "documents").select("doc_id", "text")))
    return fill_middle.digests(fill_middle.transformed(store, "doc_id", seed=1))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup, op2_pii, op3_token_files, op4_exact_topk, op5_decontamination, op6_byte_bpe, op7_substring_dedup,
        op8_line_dedup, op9_toxicity, op10_pitman_yor, op11_vector_codes, op12_url_filter, op13_fill_middle,
    )
}
ORACLES = {
    "op1_minhash_dedup": sql.OP1,
    "op2_pii": sql.OP2,
    "op4_exact_topk": sql.OP4,
    "op5_decontamination": sql.OP5,
    "op7_substring_dedup": sql.OP7,
    "op8_line_dedup": sql.OP8,
    "op11_vector_codes": sql.vector_codes(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS),
    "op12_url_filter": sql.url_filter(HOST_RULES, [url_rules.pattern(text) for text in URL_PATTERNS]),
    "op13_fill_middle": sql.OP13,
}
