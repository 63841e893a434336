"""Dedup, merge, diff and validation of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import AMBIGUOUS, EXTRACTED, INFERRED, Graph, one_of

NODE_KEY, EDGE_KEY = ("id",), ("source", "target", "relation")


def first_of(df: DataFrame, *key: str) -> DataFrame:
    """The first row in ``ord`` of each key."""
    w = Window.partitionBy(*key).orderBy("ord")
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def dedup(graph: Graph) -> Graph:
    return Graph(first_of(graph.nodes, *NODE_KEY), first_of(graph.edges, *EDGE_KEY), graph.hyperedges)


def merge(*graphs: Graph) -> Graph:
    """Union of extractions; the first of each node id and edge key stays.  Those of later graphs come after all of earlier ones."""

    def together(name: str) -> DataFrame | None:
        parts = [(i, getattr(g, name)) for i, g in enumerate(graphs) if getattr(g, name) is not None]
        out = None
        for i, df in parts:
            df = df.withColumn("__g", F.lit(i))
            out = df if out is None else out.unionByName(df)
        return out

    def first(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
        w = Window.partitionBy(*key).orderBy("__g", "ord")
        return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__g")

    hyper = together("hyperedges")
    return Graph(first(together("nodes"), NODE_KEY), first(together("edges"), EDGE_KEY), None if hyper is None else hyper.drop("__g"))


def merge_into(graph: Graph, new: Graph, prune: DataFrame | None = None) -> Graph:
    """Appends nodes of unknown ids and edges of unknown (source, target); nothing is updated.  ``prune`` names source files
    (``source_file``) that were read again: what they had is dropped first."""
    nodes, edges = graph.nodes, graph.edges
    if prune is not None:
        nodes, edges = nodes.join(prune, "source_file", "left_anti"), edges.join(prune, "source_file", "left_anti")
    nodes = nodes.unionByName(first_of(new.nodes, "id").join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))
    edges = edges.unionByName(new.edges.join(edges.select("source", "target"), ["source", "target"], "left_anti").select(*edges.columns))
    hyper = [h for h in (graph.hyperedges, new.hyperedges) if h is not None]
    return Graph(nodes, edges, hyper[0].unionByName(hyper[1]) if len(hyper) == 2 else (hyper or [None])[0])


def diff_nodes(old: Graph, new: Graph) -> DataFrame:
    """``change, id, label``"""
    one = lambda a, b, said: a.nodes.join(b.nodes.select("id"), "id", "left_anti").select(F.lit(said).alias("change"), "id", "label")
    return one(new, old, "new").union(one(old, new, "removed"))


def diff_edges(old: Graph, new: Graph) -> DataFrame:
    """``change, source, target, relation, confidence``; confidence in its display form."""
    key = list(EDGE_KEY)

    def one(a: Graph, b: Graph, said: str) -> DataFrame:
        return a.edges.join(b.edges.select(*key), key, "left_anti").select(F.lit(said).alias("change"), *key, F.initcap("confidence").alias("confidence"))

    return one(new, old, "new").union(one(old, new, "removed"))


def diff_summary(old: Graph, new: Graph) -> DataFrame:
    """``new_nodes, new_edges, removed_nodes, removed_edges, summary``"""
    both = diff_nodes(old, new).select(F.concat("change", F.lit("_nodes")).alias("k")).union(diff_edges(old, new).select(F.concat("change", F.lit("_edges"))))
    names = ("new_nodes", "new_edges", "removed_nodes", "removed_edges")
    counts = both.agg(*[F.count_if(F.col("k") == n).alias(n) for n in names])

    def said(n: str) -> F.Column:
        change, what = n.split("_")
        thing = F.concat(F.lit(what[:-1]), F.when(F.col(n) == 1, "").otherwise("s"))
        words = (F.col(n), F.lit(change), thing) if change == "new" else (F.col(n), thing, F.lit(change))
        return F.when(F.col(n) > 0, F.concat_ws(" ", *words))

    text = F.concat_ws(", ", *[said(n) for n in names])
    return counts.withColumn("summary", F.when(text == "", "no changes").otherwise(text))


def violations(graph: Graph) -> DataFrame:
    """``kind, ord, id``: every breach of the graph's rules, in the order in which they would be met."""
    n, e = graph.nodes, graph.edges
    known = n.select(F.col("id").alias("k")).distinct()
    w = Window.partitionBy("id").orderBy("ord")
    twice = n.withColumn("i", F.row_number().over(w)).filter("i > 1").select(F.lit("DuplicateNodeId").alias("kind"), "ord", "id")
    unknown = lambda end: e.join(known, F.col(end) == F.col("k"), "left_anti").select(F.lit("UnknownNodeReference").alias("kind"), "ord", F.col(end).alias("id"))
    return (
        n.filter("id is null or id = ''").select(F.lit("EmptyNodeId").alias("kind"), "ord", "id")
        .union(n.filter("label is null or label = ''").select(F.lit("EmptyLabel"), "ord", "id"))
        .union(twice).union(unknown("source")).union(unknown("target"))
    )


def error_texts(graph: Graph) -> DataFrame:
    """``kind, ord, id, message``: what ``violations`` finds and confidences that aren't one of the three, in words."""
    e = graph.edges.select("ord", F.concat("source", F.lit(" -> "), "target").alias("edge"), "confidence")
    odd = e.filter(~F.coalesce(F.col("confidence").isin(EXTRACTED, INFERRED, AMBIGUOUS), F.lit(False))).select(F.lit("InvalidConfidence").alias("kind"), "ord", F.coalesce("confidence", F.lit("")).alias("id"), F.lit(None).cast("string").alias("edge"))
    found = violations(graph).withColumn("edge", F.lit(None).cast("string"))
    ends = found.filter("kind = 'UnknownNodeReference'").drop("edge").join(e.select("ord", "edge"), "ord")
    found = found.filter("kind <> 'UnknownNodeReference'").unionByName(ends).unionByName(odd)
    texts = {
        "DuplicateNodeId": F.concat(F.lit("Duplicate node ID: "), "id"),
        "UnknownNodeReference": F.concat(F.lit("Edge '"), "edge", F.lit("' references unknown node: "), "id"),
        "EmptyNodeId": F.lit("Node has empty ID"),
        "EmptyLabel": F.lit("Node has empty label"),
        "InvalidConfidence": F.concat(F.lit("Invalid confidence value: "), "id", F.lit(f" (not {EXTRACTED}, {INFERRED} or {AMBIGUOUS})")),
    }
    return found.select("kind", "ord", "id", one_of("kind", texts).alias("message"))
