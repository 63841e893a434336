"""The property graph and hypergraph as DataFrames, and the plans that most operators begin with."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "id string, label string, source_file string, source_location string, community int, node_type string, file_type string, file_stem string, ord long"
EDGE = "source string, target string, relation string, confidence string, confidence_score double, source_file string, note string, ord long"
HYPEREDGE = "id string, label string, nodes array<string>, relation string, confidence string, confidence_score double, source_file string, ord long"
EXTRACTED, INFERRED, AMBIGUOUS = "EXTRACTED", "INFERRED", "AMBIGUOUS"


def one_of(column: str, values: dict, default=None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out.otherwise(default)


def confidence_score(column: str = "confidence") -> Column:
    return one_of(column, {EXTRACTED: 1.0, INFERRED: 0.75, AMBIGUOUS: 0.2})


def doubtful_first(column: str = "confidence") -> Column:
    return one_of(column, {AMBIGUOUS: 0, INFERRED: 1}, 2)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in order; those that are missing are null."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


@dataclass(frozen=True)
class Graph:
    """``nodes``, ``edges`` and ``hyperedges``; ``ord`` gives each table's order, for first-wins and ties."""

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None

    def with_hyperedges(self, hyperedges: DataFrame) -> Graph:
        return replace(self, hyperedges=hyperedges)

    @property
    def members(self) -> DataFrame:
        """``he, he_ord, node_id``: one row for each node of each hyperedge."""
        return self.hyperedges.select(F.col("id").alias("he"), F.col("ord").alias("he_ord"), F.explode("nodes").alias("node_id"))

    @property
    def adjacent(self) -> DataFrame:
        """``a, b, pos``: both directions of each edge, in edge order."""
        e = self.edges
        return e.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("ord").alias("pos")).union(e.select("target", "source", "ord"))

    @property
    def endpoints(self) -> DataFrame:
        """Degree by endpoint: a loop counts twice, ids without a node are there."""
        ends = self.edges.select(F.explode(F.array("source", "target")).alias("id"))
        return ends.groupBy("id").agg(F.count("*").alias("degree"))

    @property
    def incident(self) -> DataFrame:
        """Degree by edge of every node: a loop counts once, isolated nodes have 0."""
        ends = self.edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
        counted = ends.groupBy("id").agg(F.count("*").alias("degree"))
        return self.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
