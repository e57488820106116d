"""The queries that apply the operators of this folder, with production parameters, to their whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, itemsets, maxscore, merkle, ngram_join, packing, pii, quality, secrets, sharding, spans, warc
from .common import cut, new_folder, spread, table
from .oracles import ORACLE_SQL as ORACLE_SQL


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_texts(spark, sf_dir), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans_of(_texts(spark, sf_dir))
    base = F.col("base")
    return found.select(
        "doc_id",
        *(spans.count(base, k).alias(f"n_{pii.KINDS[k]}") for k in range(pii.TERM)),
        F.sha2(spans.listed(base, pii.KINDS), 256).alias("base_sha256"),
        spans.listed(F.col("all"), pii.KINDS).alias("spans"),
    )


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_texts(spark, sf_dir), vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids"
    )
    return bpe.decode(encoded, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_texts(spark, sf_dir))
    base = F.col("secrets.base")
    return found.select(
        "doc_id",
        *(spans.count(base, k).alias(f"n_{secrets.KINDS[k]}") for k in range(secrets.BASE)),
        F.sha2(spans.listed(base, secrets.KINDS), 256).alias("base_sha256"),
        spans.listed(F.col("secrets.all"), secrets.KINDS).alias("spans"),
    )


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(_texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(made)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_texts(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    # both leaves are made while the text is at hand; the text goes no further
    rows = docs.select("doc_id", "lang", merkle.leaf(*columns, F.col("text")).alias("given"), merkle.leaf(*columns, tampered).alias("now"))
    made = merkle.manifest(rows, F.col("given"))
    made = made.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("now"), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    found = cut(warc.records(spark, folder, with_payload=False))
    return warc.pages(warc.captures(found)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, made, support, total = itemsets.closed_sets(table(spark, sf_dir, "sale_lines"))
    found = itemsets.with_rules(closed, made, support, total)
    listed = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", *(r[c].cast("string") for c in "cas"))), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))))
    return found.select(
        F.array_join(F.col("z").cast("array<string>"), ",").alias("items"),
        F.size("z").cast("long").alias("n_items"),
        F.col("s").cast("long").alias("support"),
        F.size("rules").cast("long").alias("n_rules"),
        best["c"].alias("best_item"),
        F.sha2(listed, 256).alias("rules_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_pii": op2_pii,
    "op3_chat_repair": op3_chat_repair,
    "op4_quality": op4_quality,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_ann": op6_ann,
    "op7_secret_scan": op7_secret_scan,
    "op8_maxscore": op8_maxscore,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_sharding": op10_sharding,
    "op11_merkle": op11_merkle,
    "op12_warc": op12_warc,
    "op13_itemsets": op13_itemsets,
}
