"""The stages of the corpus pipeline. Each takes a table like ``documents`` (more columns are
kept, null texts count as empty) and applies the decisions of one operator to it. The stages share
executors, whose memory a stage does not give back, so all of them bound their Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.queries import WORD_BPE, table, tokenizer_path
from tidelog.session import bounded_batches, cut


def with_text(docs: DataFrame, text) -> DataFrame:
    """The rows with another text and, where there is one, its number of characters."""
    docs = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs


def nested(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the whole row as ``row``: names that a stage adds cannot clash with
    those of other columns."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose restored text scores as toxic."""
    from tidelog.llm.toxicity import LEARNED, fit_toxicity, toxicity_score

    bounded_batches(spark)
    labels = table(spark, sf_dir, "labels")
    model = fit_toxicity(table(spark, sf_dir, "documents"), labels, LEARNED)
    return docs.where(toxicity_score(spark, model)("text") < 0.5)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the smallest id; documents
    without an id take part and come last. Near copies here are word shingles of five words and
    a similarity of 0.8 or more. Documents that share an id but not the text are not one; rows
    of one id and one text are."""
    from tidelog.llm.ngram_join import ngram_groups, row_key

    bounded_batches(spark)
    groups = ngram_groups(docs.select("doc_id", "text"), words=5, percent=80)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc")).alias("first")
    kept = groups.groupBy("component").agg(first).select(F.col("first.doc").alias("_key"))
    rows = nested(docs).withColumn("_key", row_key("doc_id", "text")).join(kept, "_key", "left_semi")
    # Rows of one key have the same id and text; of their other columns the smallest stay,
    # compared as text where they have no order (maps).
    ordered = [F.col(f"row.`{c}`") if "map<" not in kind else F.to_json(f"row.`{c}`") for c, kind in docs.dtypes if c != "text"]
    rows = rows.groupBy("_key").agg(F.min_by("row", F.struct(*ordered)).alias("row"))
    return rows.select("row.*")


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the passages of 200 bytes or more that stand anywhere else; a character that
    loses a byte goes with it."""
    from tidelog.llm.suffix_dedup import repeated_spans, without_spans

    bounded_batches(spark)
    spans = cut(repeated_spans(docs.select("doc_id", "text")))
    left = without_spans(nested(docs), spans)
    rows = left.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
    return with_text(rows, F.col("text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark such as ``<EMAIL>`` in the place of every selected span."""
    from tidelog.llm.pii import fit_pii, redacted

    bounded_batches(spark)
    return with_text(docs, redacted(spark, fit_pii(docs))("text"))


def best_fit_packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 2048 tokens."""
    from tidelog.llm.packing import best_fit_packing, token_pieces

    bounded_batches(spark)
    return best_fit_packing(token_pieces(docs, tokenizer_path(WORD_BPE)))
