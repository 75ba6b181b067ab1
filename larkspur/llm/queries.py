"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import ann, chat, importance, minhash, mixing, piece_codec, quality_rules, secret_scan, simhash, sstable, target_resampling, toxicity, whitening
from larkspur.llm.shared import materialise, table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secret_scan.BASE_KINDS), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; the sizes are counted in one pass over the texts and kept as a narrow table."""
    sized = mixing.with_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mixing.mix(materialise(sized, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(piece_codec.MODEL))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sstable.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(sstable.VOCABULARY))
    return kept.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings: every example is written in full to the shared folder and read back."""
    control = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest_expanded(materialise(chat.expanded(chat.examples(rows)), "chat"))


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: the documents that are taken."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("kept")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op10_sstable": op10_sstable, "op2_simhash": op2_simhash, "op3_quality_rules": op3_quality_rules, "op4_toxicity": op4_toxicity, "op5_secrets": op5_secrets, "op6_mixing": op6_mixing, "op7_chat": op7_chat, "op8_importance": op8_importance, "op9_neighbours": op9_neighbours, "op11_whitening": op11_whitening, "op12_resampling": op12_resampling, "op13_minhash": op13_minhash}
ORACLE_SQL = {"op6_mixing": mixing.ORACLE_SQL, "op12_resampling": target_resampling.ORACLE_SQL, "op13_minhash": minhash.ORACLE_SQL}
