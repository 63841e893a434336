"""Incremental builds: changed files are extracted again and merged, in batches or from a stream of files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cluster, extract, hyper
from ..operators.build import merge, merge_into
from ..operators.report import write_report
from ..plans.graph import EDGE, HYPEREDGE, NODE, Graph, conform
from ..plans.session import cut
from ..sources import documents, files


def _empty(spark: SparkSession, folder: str) -> bool:
    """Whether a folder, also one on a cluster's file system, doesn't exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def finish(graph: Graph, chains: bool = True) -> Graph:
    """Communities and hyperedges, found anew."""
    g = cluster.cluster(graph)
    return g.with_hyperedges(conform(hyper.detect(g, chains), HYPEREDGE))


def update(spark: SparkSession, texts: DataFrame, folder: str, chains: bool = True, whole: bool = False) -> Graph:
    """The graph in ``folder`` with the files ``path, content`` that are new or changed; their old nodes and edges go first.  If ``texts`` are
    the ``whole`` source, what is known of other files goes as well.

    The folder holds Parquet tables by version, ``v<n>/nodes`` and so on, and ``v<n>/cache`` with the files' hashes; a version is
    written beside the last, so nothing that is being read is overwritten."""
    root = folder.rstrip("/")
    n = 0
    while not _empty(spark, f"{root}/v{n}/cache"):
        n += 1
    if n:
        old, cache = documents.from_parquet(spark, f"{root}/v{n - 1}"), spark.read.parquet(f"{root}/v{n - 1}/cache")
        now = extract.changed(texts, cache).filter("changed").select("path", "hash")
    else:
        old, cache = None, None
        now = extract.hashes(texts)
    now = cut(now)
    new = merge(extract.graph_of(cut(extract.facts(texts.join(now.select("path"), "path", "left_semi")))))
    if old is not None:
        plain = Graph(old.nodes.withColumn("community", F.lit(None).cast("int")), old.edges)
        gone = now.select("path")
        if whole:
            deleted = cut(cache.select("path").join(texts.select("path"), "path", "left_anti"))
            gone, cache = gone.union(deleted), cache.join(deleted, "path", "left_anti")
        new = merge_into(plain, new, prune=gone.withColumnRenamed("path", "source_file"))
        cache = extract.upsert(cache, now)
    else:
        cache = now
    done = finish(Graph(cut(conform(new.nodes, NODE)), cut(conform(new.edges, EDGE))), chains)
    documents.to_parquet(done, f"{root}/v{n}")
    cache.write.mode("overwrite").parquet(f"{root}/v{n}/cache")
    return documents.from_parquet(spark, f"{root}/v{n}")


def build(spark: SparkSession, root: str, out: str, chains: bool = True) -> Graph | None:
    """Detects, extracts and merges the code files below ``root``; writes graph.json and REPORT.md to ``out``.  None, and no output, without code."""
    found = files.detect(spark, root)
    code = cut(found.filter("skipped is null and file_type = 'code'"))
    if code.isEmpty():
        return None
    texts = cut(files.read(code))
    graph = update(spark, texts, str(Path(out).resolve() / "tables"), chains, whole=True)
    documents.to_json(graph, f"{out}/graph.json")
    n = files.words(texts.join(code.select("path", "size_bytes"), "path")).first()["words"]
    write_report(graph, f"{out}/REPORT.md", n_words=n)
    return graph


def stream(texts: DataFrame, folder: str, checkpoint: str, chains: bool = True, **trigger) -> StreamingQuery:
    """Keeps the graph in ``folder`` up to date from a streaming DataFrame ``path, content``; each batch is an update.

    Files that come again unchanged cost a hash, so a batch that is repeated after a failure does no harm."""

    def batch(df: DataFrame, _: int) -> None:
        once = df.dropDuplicates(["path"])
        if not once.isEmpty():
            update(df.sparkSession, once, folder, chains)

    out = texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of text files as they arrive in a folder."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
