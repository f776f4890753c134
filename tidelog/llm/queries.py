"""The queries of this package, each over the whole tables below its folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.workload import Registry

R = Registry()

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


@R.add("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


@R.add("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.packing import best_fit_packing, token_pieces

    return best_fit_packing(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE)))


@R.add("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.toxicity import fit_toxicity, toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@R.add("op9_imatch")
def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.imatch import imatch_fingerprints

    return imatch_fingerprints(table(spark, sf_dir, "documents"))


@R.add("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.pii import fit_pii, pii_spans

    docs = table(spark, sf_dir, "documents")
    return pii_spans(docs, fit_pii(docs))


@R.add("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), words=4, percent=85)


@R.add("op2_context_tree")
def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidelog.llm.context_tree import score_texts

    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return score_texts(table(spark, sf_dir, "documents"), training)


@R.add("op4_suffix_array")
def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.suffix_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")


@R.add("op7_nn_descent")
def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.nn_descent import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


@R.add("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@R.add("op11_merkle_manifest")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.merkle import manifest_digests, tampered_third

    return manifest_digests(table(spark, sf_dir, "documents"), tampered_third())


@R.add("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.whitening import whiten

    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", rows["deviation"].cast("long"))


@R.add("op13_segment_bpe")
def op13_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidelog.llm.segment_bpe import segment_digests

    docs = table(spark, sf_dir, "documents")
    return segment_digests(docs, tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN)
