"""Caches: what is known of files, and what was extracted from them, as Parquet tables in a shared folder.

Tables only grow: a save adds a folder ``n=<number>``, and reading takes the latest of each key, so a job that is repeated or lost halfway
damages nothing and nothing that is being read is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import content_hash
from ..plans.graph import EDGE, HYPEREDGE, NODE, Graph, conform
from ..plans.session import cut

ENTRY = "path string, hash string, size long, modified long, source_file string"
KINDS = {"nodes": NODE, "edges": EDGE, "hyperedges": HYPEREDGE}


def _folder(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _saves(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the saves in a folder that were completed."""
    fs, path = _folder(spark, folder)
    if not fs.exists(path):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(path)]
    done = [n for p, n in names if n.startswith("n=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def entries(files: DataFrame) -> DataFrame:
    """``path, hash, size, modified, source_file`` of ``path, content`` and, where there, ``size_bytes, modified, source_file``."""
    has = lambda c, default: F.col(c) if c in files.columns else default
    return conform(files.select("path", content_hash("content", "path").alias("hash"), has("size_bytes", F.octet_length("content")).alias("size"), has("modified", F.lit(None)).alias("modified"), has("source_file", F.col("path")).alias("source_file")), ENTRY)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the last save; none if nothing was saved."""
    saves = _saves(spark, folder)
    if not saves:
        return spark.createDataFrame([], ENTRY)
    return conform(spark.read.parquet(f"{folder}/n={saves[-1]}"), ENTRY)


def save(cache: DataFrame, folder: str) -> None:
    """Saves all entries as the next state of a cache."""
    saves = _saves(cache.sparkSession, folder)
    conform(cache, ENTRY).write.mode("overwrite").parquet(f"{folder}/n={saves[-1] + 1 if saves else 0}")


def add(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with new ones, which replace those of their paths."""
    return cache.join(new.select("path"), "path", "left_anti").unionByName(new)


def remove(cache: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries but those of ``paths`` (``path``)."""
    return cache.join(paths.select("path"), "path", "left_anti")


def stats(cache: DataFrame) -> DataFrame:
    """``total_entries, files_by_source``; ``cache.select('path')`` lists the paths."""
    return cache.agg(F.count("*").alias("total_entries"), F.count_distinct("source_file").alias("files_by_source"))


def save_extractions(graph: Graph, files: DataFrame, folder: str) -> int:
    """Keeps what a graph holds of each of ``files`` (``path, content``) under the hash of its content; returns how many files had something.
    Rows with an empty ``source_file``, or one that isn't among the files, aren't kept."""
    spark = files.sparkSession
    hashes = cut(files.select(F.col("path").alias("__path"), content_hash("content", "path").alias("hash")).distinct())
    kept = None
    tables = {}
    for kind in KINDS:
        df = getattr(graph, kind)
        if df is not None:
            tables[kind] = cut(df.filter("source_file <> ''").join(hashes, F.col("source_file") == F.col("__path")).drop("__path"))
            own = tables[kind].select("hash")
            kept = own if kept is None else kept.union(own)
    kept = cut(kept.distinct())
    saves = _saves(spark, f"{folder}/keys")
    n = saves[-1] + 1 if saves else 0
    for kind, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{kind}/n={n}")
    kept.write.mode("overwrite").parquet(f"{folder}/keys/n={n}")  # last: a save counts once its keys are there
    return kept.count()


def load_extractions(files: DataFrame, folder: str) -> tuple[Graph, DataFrame]:
    """(what is kept of ``files``, the files of which nothing is kept); the latest save of a hash counts."""
    spark = files.sparkSession
    saves = _saves(spark, f"{folder}/keys")
    if not saves:
        empty = {k: spark.createDataFrame([], s) for k, s in KINDS.items()}
        return Graph(**empty), files

    def rows(kind: str, schema: str) -> DataFrame | None:
        there = [n for n in _saves(spark, f"{folder}/{kind}") if n in saves]
        return spark.read.option("basePath", f"{folder}/{kind}").schema(f"{schema}, n int").parquet(*(f"{folder}/{kind}/n={n}" for n in there)) if there else None

    keys = rows("keys", "hash string").groupBy("hash").agg(F.max("n").alias("n"))
    mine = files.withColumn("__hash", content_hash("content", "path"))
    wanted = keys.join(mine.select(F.col("__hash").alias("hash")).distinct(), "hash", "left_semi")
    found = {}
    for kind, schema in KINDS.items():
        df = rows(kind, f"{schema}, hash string")
        found[kind] = spark.createDataFrame([], schema) if df is None else conform(df.join(wanted, ["hash", "n"], "left_semi"), schema)
    return Graph(**found), mine.join(wanted.select(F.col("hash").alias("__hash")), "__hash", "left_anti").drop("__hash")


def clear(spark: SparkSession, folder: str) -> int:
    """Removes all saves below a folder; returns how many there were, tables of one save counting each."""
    fs, path = _folder(spark, folder)
    n = len(_saves(spark, folder)) + sum(len(_saves(spark, f"{folder}/{k}")) for k in (*KINDS, "keys"))
    if fs.exists(path):
        fs.delete(path, True)
    return n
