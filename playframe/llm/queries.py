"""Registered queries of the operators, each next to its SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from playframe.llm import (
    alignment, chat, contamination, html, langid, lexicon, minhash, packing, quality, runs, secrets, sql, tokencount, warc)
from playframe.llm.common import table

RUNS, CHECKS = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        RUNS[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return keep


@query("op10_quality", sql.QUALITY)
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.judge(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_minhash")
def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


@query("op4_contamination")
def op4_contamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_secrets", sql.SECRETS)
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = secrets.findings(docs, secrets.Ledger(spark).update(docs), complete=True)
    found = F.col("findings")
    base = F.filter(found, lambda x: x["kind"].isin([r.kind for r in secrets.BASE]))

    def number(kind: str):
        return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(r.kind) for r in secrets.BASE]
    return out.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(found).alias("spans"))


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op2_chat", sql.CHAT)
def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(turns.unionByName(two)))


@query("op3_langid")
def op3_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict_all(table(spark, folder, "documents"))


@query("op7_tokencount")
def op7_tokencount(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, folder, "documents").select("doc_id", "text"))


@query("op1_html")
def op1_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html.extract(pages, html.fit(pages))


@query("op9_warc", sql.WARC)
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_alignment")
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.digests(table(spark, folder, "documents").select("doc_id", "text"))


@query("op12_runs")
def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.with_repeats(table(spark, folder, "documents"))))


@query("op13_bpe")
def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.digests(table(spark, folder, "documents").select("doc_id", "text"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
