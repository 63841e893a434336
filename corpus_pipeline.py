"""From raw documents to token ids: language ID, line dedup, near-duplicate removal, decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.bpe import round_trip
from skein.llm.common import fresh
from skein.llm.decontaminate import leaks
from skein.llm.langid import keep_identified, train
from skein.llm.lines import without_repeated_lines
from skein.llm.minhash import without_near_duplicates
from skein.plans.session import cut

#: Viterbi finds the languages; SQL can't express it, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None
HELD = 2_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are mostly of known languages, with the language found as their ``lang``.  Null and empty texts and those
    without words go; repeated rows and null ids are judged like any other."""
    return keep_identified(docs, train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document, or an earlier line, has; those that nothing is left of go.  Null ids come last;
    rows that are the same keep the same lines."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id (null ids last; one of rows that are the same); all others, also null
    and empty ones."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.  Texts are judged, not ids, so rows with null or repeated ids are as well; null and empty
    texts contain none."""
    (t,) = fresh(docs, "t")
    key = F.xxhash64(F.col("text").cast("string"))
    found = leaks(docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = cut(found.select(F.col("doc_id").alias(t)).distinct())
    if found.count() <= HELD:
        found = F.broadcast(found)
    return docs.join(found, key == F.col(t), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids, exact`` of each document: token ids, and whether they decode to its text.  Null and empty texts have
    none; each of repeated rows has its own; ids may be null."""
    return round_trip(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is cut before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
