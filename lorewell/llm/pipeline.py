"""A corpus from raw documents to token ids: five operators in a row, each on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, mixing, quality_rules, sentencepieces, substrings
from .common import keep, perhaps_among, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep; what is learned needs counts of labelled texts only."""
    labels = table(spark, sf_dir, "labels")
    labelled = keep(labels.where("quality IS NOT NULL").select("doc_id"))
    rules = quality_rules.learn(quality_rules.counted(perhaps_among(docs, labelled)), labels)
    return quality_rules.good(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of five-word shingles at 0.8 join; one row of it, the first by text."""
    groups = keep(jaccard.near_duplicates(docs).select("doc_id", "component_id").distinct())
    firsts = docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    again = keep(firsts.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return firsts.unionByName(docs.where("doc_id IS NULL"))
    one = firsts.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("x")).select("doc_id", "x.*")
    return firsts.join(again, "doc_id", "left_anti").unionByName(one).unionByName(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that stand earlier; those left without a word go.

    A document that loses nothing keeps its text as it is; another's words are joined by one space, and n_chars follows.
    """
    out = substrings.without_repeats(docs)
    changed = F.col("_dedup.n_removed") > 0
    text = F.when(changed, F.col("_dedup.kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("_dedup.kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    out = out.where((F.col("_dedup.n_words") > F.col("_dedup.n_removed")) | (F.col("_dedup.n_words") == 0))
    return out.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit numbers) and the decoded text of each document."""
    out = sentencepieces.encoded(docs.select("doc_id", "source", "text"), sentencepieces.model())
    return out.select("doc_id", "source", F.floor(F.octet_length("_pieces.ids") / 4).cast("long").alias("n_tokens"), F.col("_pieces.ids").alias("ids"), F.col("_pieces.decoded").alias("decoded"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing_sources", mixing_sources),
    ("sentencepiece", sentencepiece),
]

#: The learned rules, the automata and the encoder have no form in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each kept in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = keep(docs) if i < len(STAGES) - 1 else docs
    return docs
