"""The registered queries of this package; their SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldline.llm import decontaminate, langid, lmscore, mixing, pii, quality, repeats, secrets, simhash, tokens, topk, whitening, zonemaps
from fieldline.session import new_path

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    masked = pii.pseudonymise(table(spark, folder, "documents"))
    return masked.select("doc_id", "text", *[F.col("pii")[f"n_{k}"].alias(f"n_{k}") for k in pii.KINDS])


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokens.write(table(spark, folder, "documents"), path, public_tokenizers.path(WORD_BPE))
    return tokens.checksums(tokens.read(spark, path))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scores(table(spark, folder, "documents")).drop("posterior")


def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lmscore.scores(table(spark, folder, "documents"))


def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", (F.col("n_removed") > 0).alias("repeated")
    )


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.detect(table(spark, folder, "documents"))

    def joined(column: str) -> Column:
        named = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(named, ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.order(table(spark, folder, "documents")).drop("key")


def op10_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.fit(docs))


def op11_whiten(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op13_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return zonemaps.cluster(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_simhash, op2_pii, op3_decontaminate, op4_tokens, op5_quality, op6_lm_score, op7_repeats, op8_secrets, op9_mix, op10_langid,
        op11_whiten, op12_topk, op13_cluster,
    ]
    return {f.__name__: f for f in own}
