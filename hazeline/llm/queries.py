"""Registered queries of the operators: each applies one to its whole table and derives the digests asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazeline.llm import ann, bpe_codec, conversation_trie, divergence, jaccard, licences, packing, piece_codec, secrets, sharding, suffix_dedup, topk, toxicity

#: Where the vocabulary files lie; the installed package knows if this is None.
TOKENIZERS: str | None = None

#: Bytes of one shard of documents.
SHARD_BYTES = 1 << 20


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take long each: if its files make fewer tasks than there are cores, they are dealt out first."""
    df, cores = _table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(_spread(spark, sf_dir, "documents")).drop("starts", "ends")  # the kept text comes last


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.knn(_table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_spread(spark, sf_dir, "documents")).drop("found")


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_codec.round_trip(_spread(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_spread(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _spread(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_spread(spark, sf_dir, "documents"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(_spread(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_spread(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_secret_scan": op3_secret_scan,
        "op4_extendible_sharding": op4_extendible_sharding,
        "op5_exact_topk": op5_exact_topk,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_licence_scan": op7_licence_scan,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_toxicity": op9_toxicity,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_sentence_pieces": op11_sentence_pieces,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licences.spelled())
    whole = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licences.DIGESTS.items())
    digest = lambda t: f"sha256({licences.canonical_sql(t)})"
    return {
        "op4_extendible_sharding": sharding.shard_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"], SHARD_BYTES),
        "op12_conversation_trie": conversation_trie.trie_sql("conversations"),
        "op13_source_divergence": divergence.audit_sql("documents"),
        "op7_licence_scan": f"""
            WITH every AS (SELECT n, {digest("t")} AS h FROM (VALUES {rows}) AS v(n, t) UNION ALL SELECT n, h FROM (VALUES {whole}) AS w(n, h)),
                 known AS (SELECT h AS canonical_sha256, min(n) AS licence FROM every GROUP BY h),
                 found AS (SELECT doc_id, {digest("coalesce(text, '')")} AS canonical_sha256 FROM documents)
            SELECT doc_id, canonical_sha256, licence FROM found LEFT JOIN known USING (canonical_sha256)""",
    }
