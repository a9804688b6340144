"""The registered queries of this subpackage: each applies its operator to the whole
table with production parameters and derives the digest columns from its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from suitelens.llm import (alignment, chat_format, decontaminate, langid, lexical, oracles, packing, prefix_doubling, sharding, shingle_join, simhash, suffix_trees,
                           token_store, topk)
from suitelens.llm.common import END_ID, new_shared_dir, prepare, stored, table, tokenizer_path

def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_dir(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_store.read_checksums(spark, path)


def op2_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_trees.dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op5_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_doubling.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, allowed=~langid.held_out())
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    own = (spark.range(2).withColumn("conv_id", F.lit(-7).cast("long"))
           .select("conv_id", F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                   F.lit("</s>[INST] ok [/INST]").alias("text")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat_format.read_chats(stored(chat_format.format_chats(turns), "chats"))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op11_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal("print").alias("fingerprint"), "component_id")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    out = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), PATTERN)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.coalesce(F.lower(F.hex("digest")), F.lit("")).alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_suffix_trees, op3_top_products, op4_pack, op5_prefix_doubling, op6_langid,
                                   op7_decontaminate, op8_shingle_join, op9_chat_format, op10_shard, op11_fp_tree_search, op12_simhash_trie, op13_align)} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = oracles.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
