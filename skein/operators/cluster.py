"""Components and communities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components as linked
from ..plans.graph import EXTRACTED, Graph
from ..plans.session import cut, numbered
from .build import merge


def between(e: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges ``a, b`` whose ends are both nodes ``id``.  They stay in the partitions that they are in, unless there are ends without a
    node."""
    e = cut(e)
    unknown = cut(e.select(F.explode(F.array("a", "b")).alias("a")).distinct().join(ids.select(F.col("id").alias("a")), "a", "left_anti"))
    if not unknown.isEmpty():
        for end in "ab":
            e = e.join(unknown.select(F.col("a").alias("u")), F.col(end).eqNullSafe(F.col("u")), "left_anti")
    return e


def components(graph: Graph) -> DataFrame:
    """``id, root``: the least id of each node's component, over edges between nodes; a node without links is its own root."""
    ids = graph.nodes.select("id").distinct()
    found = linked(between(graph.edges.filter("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b")), ids))
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def local_move(n: int, edges: list[tuple[int, int, float]], m: float, sweeps: int = 10) -> list[int]:
    """Modularity local moves over nodes 0 to n - 1 in turn, in place; ties go to the least community.  ``m`` is the weight of the whole graph."""
    own = list(range(n))
    near: list[dict[int, float]] = [{} for _ in range(n)]
    k = [0.0] * n
    for a, b, w in edges:
        k[a] += w
        k[b] += w
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    weight = k[:]
    for _ in range(sweeps if m > 0 else 0):
        moved = False
        for i in range(n):
            to: dict[int, float] = {}
            for j, w in near[i].items():
                to[own[j]] = to.get(own[j], 0.0) + w
            here, stay = own[i], to.get(own[i], 0.0)
            best, gain_best = here, 1e-10
            for c in sorted(to):
                if c != here:
                    gain = (to[c] - stay) / m - k[i] * (weight[c] - k[i]) / (m * m)
                    if gain > gain_best:
                        best, gain_best = c, gain
            if best != here:
                weight[here] -= k[i]
                weight[best] += k[i]
                own[i] = best
                moved = True
        if not moved:
            break
    return own


def _moved(rows: DataFrame, group: str, total: str) -> DataFrame:
    """``id, g, local``: local moves within each group of rows ``group, id, ord, other, w, total`` (``other`` null for a node's own
    row).  Rows come sorted by group, so a task holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, links, m = None, [], [], 0.0

        def done() -> pa.RecordBatch:
            ids = [i for _, i in sorted(nodes)]
            at = {i: k for k, i in enumerate(ids)}
            own = local_move(len(ids), [(at[a], at[b], w) for a, b, w in links], m)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([str(now)] * len(ids), pa.string()), pa.array([ids[c] for c in own], pa.string())], names=["id", "g", "local"])

        for batch in batches:
            for g, i, o, other, w, t in zip(*(c.to_pylist() for c in batch.columns)):
                if g != now:
                    if nodes:
                        yield done()
                    now, nodes, links, m = g, [], [], t
                if other is None:
                    nodes.append((o, i))
                else:
                    links.append((i, other, w))
        if nodes:
            yield done()

    sorted_ = rows.select(F.col(group).cast("string"), "id", "ord", "other", "w", total).repartition(group).sortWithinPartitions(group, "ord", "other")
    return sorted_.mapInArrow(run, "id string, g string, local string")


def _weights(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Edges between nodes with their weight: ``source, target, w, ord``."""
    ids = nodes.select("id").distinct()
    e = graph.edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    return e.select("source", "target", F.when(F.col("confidence") == EXTRACTED, 1.0).otherwise(0.5).alias("w"), F.col("ord").alias("e_ord"))


def leiden(graph: Graph) -> DataFrame:
    """``id, community``: communities by modularity local moves, numbered from 0 by size, the largest first, then by first node.

    Moves only lead to neighbours' communities and otherwise only need the weight of the whole graph, so each connected
    component is a task of its own and the result is that of the whole.  Without edges each node is a community."""
    roots = components(graph)
    nodes = graph.nodes.groupBy("id").agg(F.min("ord").alias("ord")).join(roots, "id")
    w = _weights(graph, graph.nodes)
    m = w.agg(F.sum("w")).first()[0] or 0.0
    links = w.join(roots.withColumnRenamed("id", "source"), "source").select("root", F.col("source").alias("id"), F.col("e_ord").alias("ord"), F.col("target").alias("other"), "w")
    rows = nodes.select("root", "id", "ord", F.lit(None).cast("string").alias("other"), F.lit(0.0).alias("w")).union(links).withColumn("m", F.lit(float(m)))
    found = cut(_moved(rows, "root", "m").join(nodes.select("id", "ord"), "id"))
    return _numbered(found, ["local"])


def _numbered(found: DataFrame, key: list[str]) -> DataFrame:
    sizes = found.groupBy(*key).agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    ranked = numbered(sizes, "community", F.desc("n"), "o").withColumn("community", F.col("community").cast("int"))
    return found.join(ranked.select(*key, "community"), key).select("id", "community")


def with_communities(graph: Graph, found: DataFrame) -> Graph:
    nodes = graph.nodes.drop("community").join(found, "id", "left").select(*graph.nodes.columns)
    return Graph(nodes, graph.edges, graph.hyperedges)


def split_oversized(graph: Graph, most: int = 25) -> DataFrame:
    """``id, community`` of all nodes: local moves once more within each community of more than ``most`` nodes that has edges.
    The largest part keeps the number, the others get new ones, by old number, then by size."""
    sizes = graph.nodes.filter("community is not null").groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("community")
    large = graph.nodes.join(F.broadcast(sizes), "community", "left_semi")
    own = large.select(F.col("id"), F.col("community").alias("c"))
    w = _weights(graph, large).join(own.withColumnRenamed("id", "source"), "source").join(own.select(F.col("id").alias("target"), F.col("c").alias("d")), "target").filter("c = d")
    m = w.groupBy("c").agg(F.sum("w").alias("m"))
    rows = large.select(F.col("community").alias("c"), "id", "ord", F.lit(None).cast("string").alias("other"), F.lit(0.0).alias("w")).union(w.select("c", F.col("source").alias("id"), F.col("e_ord").alias("ord"), F.col("target").alias("other"), "w")).join(F.broadcast(m), "c")
    found = _moved(rows, "c", "m").join(large.select("id", "ord"), "id")
    parts = found.groupBy("g", "local").agg(F.count("*").alias("n"), F.min("ord").alias("o")).withColumn("sub", F.expr("row_number() over (partition by g order by n desc, o)") - 1)
    top = graph.nodes.agg(F.max("community").alias("top"))
    fresh = numbered(parts.filter("sub > 0").withColumn("c", F.col("g").cast("int")), "k", "c", "sub").crossJoin(top).select("g", "local", (F.col("top") + F.col("k") + 1).alias("c2"))
    changed = found.join(fresh, ["g", "local"]).select("id", "c2")
    return graph.nodes.select("id", "community").join(changed, "id", "left").select("id", F.coalesce("c2", "community").cast("int").alias("community"))


def cluster(graph: Graph, most: int = 25) -> Graph:
    found = with_communities(graph, cut(leiden(graph)))
    return with_communities(found, cut(split_oversized(found, most)))


def build_graph(*extractions: Graph, most: int = 25) -> Graph:
    """One graph from extractions: the first of each node id, in order of ids, and of each edge; communities of at most ``most`` nodes where
    they can be split; all hyperedges."""
    g = merge(*extractions)
    nodes = numbered(g.nodes.drop("ord"), "ord", "id").select(*g.nodes.columns)
    edges = g.edges if len(extractions) == 1 else cut(_after(extractions, g.edges))
    return cluster(Graph(cut(nodes), edges, g.hyperedges), most)


def _after(extractions: tuple[Graph, ...], edges: DataFrame) -> DataFrame:
    """Edges numbered anew: those of an extraction come after those of the ones before."""
    own = None
    for i, g in enumerate(extractions):
        one = g.edges.select("source", "target", "relation", "ord").withColumn("__g", F.lit(i))
        own = one if own is None else own.union(one)
    place = own.groupBy("source", "target", "relation").agg(F.min(F.struct("__g", "ord")).alias("__o"))
    return numbered(edges.drop("ord").join(place, ["source", "target", "relation"]), "ord", "__o").select(*edges.columns)
