"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.core.shared import materialise
from sextant.llm import align, bottomk, bpe, chat, coder, decontaminate, html, jaccard, lm, quality, rules, runs, urls
from sextant.llm.words import crc_of_id


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_network(docs: DataFrame, labels: DataFrame) -> quality.Network | None:
    trusted = labels.where((F.pmod(crc_of_id("doc_id"), F.lit(5)) != 0) & F.col("quality").isNotNull())
    positives = trusted.where("quality = 1").select("doc_id")
    pool = docs.where(F.pmod(crc_of_id("doc_id"), F.lit(5)) != 0).select("doc_id")
    return quality.train(docs, positives, pool)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_network(docs, _read(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(crc_of_id("doc_id"), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")
    return bpe.encode(docs, path, bpe.lexicon(docs, path), digest=True)


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(rules.ledger(_read(spark, sf_dir, "documents")), "ledger")  # from here on no text is read
    rows = rules.apply_policy(rules.apply_policy(rows, rules.BASE, to="base_ok"), rules.POLICIES[rules.CURRENT])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), (F.col("base_ok") & F.col("kept")).alias("kept"), "failures")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_turns(chat.own_conversation(_read(spark, sf_dir, "conversations")))).drop("n_rewrites")


URL_RULES: urls.Rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = coder.round_trip(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc_of_id("doc_id"), F.lit(7)) == 2, F.lit(False))
    model = lm.train(docs.where(~held_out))
    return lm.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(_read(spark, sf_dir, "documents"), rewrite=runs.plant)


def op12_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.grouped(_read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_rules": op3_rules,
    "op4_html": op4_html,
    "op5_chat": op5_chat,
    "op6_urls": op6_urls,
    "op7_token_files": op7_token_files,
    "op8_jaccard": op8_jaccard,
    "op9_decontaminate": op9_decontaminate,
    "op10_lm": op10_lm,
    "op11_runs": op11_runs,
    "op12_bottomk": op12_bottomk,
    "op13_alignment": op13_alignment,
}
