"""The registered queries of the operators of this folder, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logferry.llm import (
    decontaminate, filter_audit, hamming, importance, language, near_dups, packing, passages, quality_rules, quality_vote, quotes, secrets, urls,
)
from logferry.llm.common import table
from logferry.plans.registry import query


def fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# The rules of the url contract, and the hosts that the list blocks, read off the given pages.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_HOSTS = [f"{name}.example.{zone}" for name in BLOCKED_NAMES for zone in ("com", "net", "org")]


@query("op1_urls")
def op1_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), urls.entries(spark, URL_RULES, BLOCKED_HOSTS))


@query("op2_quality_rules", quality_rules.ORACLE)
def op2_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query("op3_quality_vote")
def op3_quality_vote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    voters = quality_vote.fit(docs.where(fold(4) != 2), table(spark, sf_dir, "labels"))
    return quality_vote.score(docs, voters).select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


@query("op4_secrets", secrets.ORACLE)
def op4_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    findings, _ = secrets.deliveries(docs)
    return secrets.per_path(docs, findings)


@query("op5_language")
def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs.where(fold(3) != 1)))
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_passages")
def op6_passages(spark, sf_dir):
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_near_duplicates")
def op8_near_duplicates(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_decontaminate", decontaminate.ORACLE)
def op9_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_quotes", quotes.ORACLE)
def op10_quotes(spark, sf_dir):
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


@query("op12_importance", importance.ORACLE)
def op12_importance(spark, sf_dir):
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("n_words")


@query("op13_filter_audit", filter_audit.ORACLE)
def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_hamming")
def op11_hamming(spark, sf_dir):
    return hamming.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
