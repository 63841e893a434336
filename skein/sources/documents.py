"""Graphs as JSON documents and Parquet tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import EDGE, HYPEREDGE, NODE, Graph, conform


def _struct(schema: str) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in schema.split(", ")) if n != "ord") + ">"


DOCUMENT = f"nodes array<{_struct(NODE)}>, links array<{_struct(EDGE)}>, edges array<{_struct(EDGE)}>, hyperedges array<{_struct(HYPEREDGE)}>, metadata struct<total_nodes: long, total_edges: long, communities: long, created: string>"


def from_json(spark: SparkSession, path: str) -> Graph:
    """A graph from a JSON document; edges may be named links or edges.  Places in its lists give the order."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    links = F.coalesce("links", "edges")

    def rows(column, schema: str) -> DataFrame:
        return conform(doc.select(F.posexplode(column).alias("ord", "x")).select("x.*", "ord"), schema)

    edges = rows(links, EDGE).withColumns({"confidence_score": F.coalesce("confidence_score", F.lit(0.0)), "source_file": F.coalesce("source_file", F.lit(""))})
    nodes = rows(F.col("nodes"), NODE).withColumn("source_location", F.coalesce("source_location", F.lit("")))
    return Graph(nodes, edges, rows(F.col("hyperedges"), HYPEREDGE))


def metadata(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count("*").alias("total_nodes"), F.count_distinct("community").alias("communities"))
    e = graph.edges.agg(F.count("*").alias("total_edges"))
    return n.crossJoin(e).select("total_nodes", "total_edges", "communities", F.unix_timestamp().cast("string").alias("created"))


def to_json(graph: Graph, path: str) -> None:
    """One JSON document.  Rows stream through the driver in order, so it fits graphs that one file fits; use ``to_parquet`` beyond."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w") as f:
        f.write("{")
        for name, df in (("nodes", graph.nodes), ("links", graph.edges), ("hyperedges", graph.hyperedges)):
            f.write(f'"{name}": [')
            if df is not None:
                for i, r in enumerate(df.orderBy("ord").drop("ord").toJSON().toLocalIterator()):
                    f.write(",\n" * bool(i) + r)
            f.write("],\n")
        f.write(f'"metadata": {metadata(graph).toJSON().first()}}}\n')


def export_stats(graph: Graph, path: str) -> dict:
    """Totals as a JSON file, and as a dict."""
    from ..operators.analyze import confidence_counts

    r = metadata(graph).crossJoin(graph.edges.agg(*confidence_counts())).first().asDict()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(r, indent=2))
    return r


def to_parquet(graph: Graph, folder: str) -> None:
    for name in ("nodes", "edges", "hyperedges"):
        if getattr(graph, name) is not None:
            getattr(graph, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def from_parquet(spark: SparkSession, folder: str) -> Graph:
    read = lambda name, schema: conform(spark.read.parquet(f"{folder}/{name}"), schema)
    return Graph(read("nodes", NODE), read("edges", EDGE), read("hyperedges", HYPEREDGE))
