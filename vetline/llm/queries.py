"""The operators on the given tables, one query each."""

from __future__ import annotations

import importlib.util
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm import ann, packing, pii, quality, sharding, simhash, substring_dedup, tiling, token_file, toxicity, vector_codes, vocabulary, warc
from vetline.llm.oracles import ORACLE_SQL  # noqa: F401  (the driver's entry reads it here)
from vetline.session import checkpoint_dir
from vetline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files lie; TOKENIZER_DIR names another folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    return os.path.join(os.path.dirname(importlib.util.find_spec("public_tokenizers").origin), name)


@register
def op1_nearest_neighbours(spark, sf_dir):
    """The 10 nearest vectors found for every hundredth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10).select(
        F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")


@register
def op2_substring_dedup(spark, sf_dir):
    """Words of documents without 20-word passages that occurred earlier."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op3_personal_data(spark, sf_dir):
    """Personal data of documents: exact patterns, and spans found by context."""
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"))


@register
def op4_quality(spark, sf_dir):
    """Quality of documents by positive-unlabelled learning."""
    rows = quality.feature_table(table(spark, sf_dir, "documents"))
    return quality.scores(rows, quality.fit(rows, table(spark, sf_dir, "labels")))


@register
def op5_simhash_neardup(spark, sf_dir):
    """SimHash components of documents at 4 differing bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@register
def op6_warc_archive(spark, sf_dir):
    """Pages written to a content-addressed archive and read back."""
    path = scratch(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    return warc.read_archive(spark, path).withColumn("sha1", F.sha1("payload")).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.base32("sha1").alias("payload_digest"), "record_type", "refers_to")


@register
def op7_toxicity(spark, sf_dir):
    """Toxicity of documents, and the sentences that make it."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register
def op8_token_file(spark, sf_dir):
    """Documents as token ids in a packed file, read back."""
    path = scratch(spark, "tokens")
    token_file.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    return token_file.read_documents(spark, path, ids=False)


@register
def op9_packing(spark, sf_dir):
    """Documents packed into sequences of 512 to 4096 words."""
    return packing.pack(packing.word_counts(table(spark, sf_dir, "documents")))


@register
def op10_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, in whatever order of its parts."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op11_sharding(spark, sf_dir):
    """Documents on a ring of 16 shards whose counts are at most one apart."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = sharding.shard(docs, 16, key_col="doc_id", order_cols=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op12_source_divergence(spark, sf_dir):
    """Divergence of each source's vocabulary from the other sources of its language."""
    return vocabulary.divergence(table(spark, sf_dir, "documents"))


@register
def op13_vector_codes(spark, sf_dir):
    """Vectors as product codes of 16 parts and 64 entries each."""
    codes, books, _ = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    sha = F.create_map(*[F.lit(x) for n, b in books.items() for x in (n, vector_codes.digest(b))]) if books else None
    out = vector_codes.with_label_errors(codes)
    return out.select(F.col("id").cast("long").alias("vec_id"), vector_codes.code_text(F.col("code")).alias("code"), "error", "label_error",
                      (sha[F.col("length")] if books else F.lit(None).cast("string")).alias("codebooks_sha256"))
