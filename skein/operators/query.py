"""Keyword scores, filters, traversals, paths and lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import rounded
from ..plans.graph import Graph
from ..plans.session import cut, numbered


def terms(question: str) -> list[str]:
    """Lower-cased words of more than two bytes, with repeats."""
    return [w.lower() for w in question.split() if len(w.encode()) > 2]


def score_nodes(graph: Graph, words: list[str]) -> DataFrame:
    """``id, score, ord`` of the nodes that match: for each word 1 if the label has it and 0.5 if the file has it."""
    score = F.lit(0.0)
    for w in words:
        for column, weight in (("label", 1.0), ("source_file", 0.5)):
            score = score + F.when(F.contains(F.lower(column), F.lit(w)), weight).otherwise(0.0)
    return graph.nodes.withColumn("score", score).filter("score > 0")


def filtered(nodes: DataFrame, graph: Graph, node_type: str | None = None, community: int | None = None, source: str | None = None, hyperedge: str | None = None) -> DataFrame:
    """Rows of nodes that pass every filter given; null never passes."""
    has = lambda c, x: F.contains(F.lower(c), F.lit(x.lower()))
    if node_type is not None:
        nodes = nodes.filter(has("node_type", node_type))
    if community is not None:
        nodes = nodes.filter(F.col("community") == community)
    if source is not None:
        nodes = nodes.filter(has("source_file", source))
    if hyperedge is not None:
        held = graph.hyperedges.filter(has("label", hyperedge)).select(F.explode("nodes").alias("id"))
        nodes = nodes.join(held, "id", "left_semi")
    return nodes


def best(graph: Graph, question: str, n: int = 3, **filters) -> DataFrame:
    """The ``n`` best nodes of a question: highest score, first in order."""
    return filtered(score_nodes(graph, terms(question)), graph, **filters).orderBy(F.desc("score"), "ord").limit(n)


def bfs(graph: Graph, starts: DataFrame, depth: int = 3, include_reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``id, level``, edges): nodes within ``depth`` steps of ``starts`` (``id``), whatever the direction, and the edges that
    lead to new nodes.

    For every link from a node of a level to a node not yet seen the first edge in that direction counts; links that only exist the other way are
    followed but give no edge, unless ``include_reverse``.  The starts and the edges are cut once, and so is each level, so none is planned
    again by the next; a level is one join of its new nodes, each once, with the links."""
    edges = cut(graph.edges)
    starts, adj = cut(starts.select("id").distinct()), Graph(graph.nodes, edges).adjacent
    w = Window.partitionBy("source", "target").orderBy("ord")
    forward = edges.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    seen = starts.withColumn("level", F.lit(0))
    front, met = starts, None
    for d in range(1, depth + 1):
        step = adj.join(front, F.col("a") == F.col("id"), "left_semi").join(seen.select("id"), F.col("b") == F.col("id"), "left_anti")
        step = cut(step.select("a", "b"))
        met = step if met is None else met.union(step)
        front = cut(step.select(F.col("b").alias("id")).distinct())
        seen = seen.union(front.withColumn("level", F.lit(d)))
    if met is None:
        return seen, edges.limit(0)
    hop = met.select(F.col("a").alias("source"), F.col("b").alias("target"))
    found = hop.join(forward, ["source", "target"]).select(*edges.columns)
    if include_reverse:
        back = hop.join(forward, ["source", "target"], "left_anti").select(F.col("source").alias("target"), F.col("target").alias("source"))
        found = found.union(back.join(forward, ["source", "target"]).select(*edges.columns))
    return seen, found


def dfs(graph: Graph, starts: DataFrame, depth: int = 3) -> DataFrame:
    """``kind, a, b, ord``: nodes ('node', id, null) and links ('edge', source, target) of a depth-first walk with a stack, in order.

    The walk is sequential, so it runs in one task, over what lies within ``depth`` steps (which BFS finds first)."""
    ball, _ = bfs(graph, starts, depth)
    near = ball.select("id")
    adj = graph.adjacent.join(near, F.col("a") == F.col("id"), "left_semi")
    known = graph.edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct().withColumn("known", F.lit(True))
    adj = adj.join(known, ["a", "b"], "left").select("a", "b", "pos", "known")
    rows = adj.union(starts.select("id", F.lit(None).cast("string"), F.coalesce("ord", F.lit(0)), F.lit(False)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[str] = []
        links: dict[str, list] = {}
        for batch in batches:
            for a, b, _, known_ in zip(*(c.to_pylist() for c in batch.columns)):
                if b is None:
                    first.append(a)
                else:
                    links.setdefault(a, []).append((b, known_))
        stack, seen, out = [(a, 0) for a in reversed(first)], set(), []
        while stack:
            a, d = stack.pop()
            if a in seen or d > depth:
                continue
            seen.add(a)
            out.append(("node", a, None))
            for b, known_ in links.get(a, ()):
                if b not in seen:
                    stack.append((b, d + 1))
                    if known_ is True:
                        out.append(("edge", a, b))
        columns = [pa.array([r[k] for r in out], pa.string()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(out)), pa.int64())], names=["kind", "a", "b", "ord"])

    return rows.repartition(1).sortWithinPartitions("pos", "b").mapInArrow(walk, "kind string, a string, b string, ord long")


def shortest_path(graph: Graph, source: str, target: str, max_hops: int = 8) -> list[str] | None:
    """Ids along a shortest undirected path of at most ``max_hops`` links, None if there is none.  Of equals, the one that a
    queue would find first.  Each hop is a job over the front; only the path comes to the driver."""
    if source == target:
        return [source]
    spark = graph.edges.sparkSession
    adj = graph.adjacent
    front = spark.createDataFrame([(source, 0)], "id string, rank long")
    seen = front.select("id")
    levels = []
    for _ in range(max_hops):
        step = front.join(adj, F.col("id") == F.col("a")).join(seen.withColumnRenamed("id", "s"), F.col("b") == F.col("s"), "left_anti")
        found = cut(step.groupBy("b").agg(F.min(F.struct("rank", "pos", "a")).alias("m")).select(F.col("b").alias("id"), F.col("m.a").alias("up"), F.col("m.rank").alias("up_rank"), F.col("m.pos").alias("pos")))
        levels.append(found)
        if not found.filter(F.col("id") == target).isEmpty():
            path = [target]
            for level in reversed(levels):
                path.append(level.filter(F.col("id") == path[-1]).first()["up"])
            return path[::-1]
        if found.isEmpty():
            return None
        # the order in which a queue holds them: by the finder's own order, then by link
        order = found.select("id", F.struct("up_rank", "pos").alias("o"))
        front = cut(numbered(order, "rank", "o").select("id", "rank"))
        seen = cut(seen.union(found.select("id")))
    return None


def path_rows(graph: Graph, source: str, target: str, max_hops: int = 8) -> DataFrame:
    """``pos, id``, empty if there is no path."""
    path = shortest_path(graph, source, target, max_hops) or []
    return graph.nodes.sparkSession.createDataFrame(list(enumerate(path)), "pos long, id string")


def labelled(graph: Graph, edges: DataFrame) -> DataFrame:
    """The edges with ``source_label`` and ``target_label``; an id without a node is its own label."""
    names = graph.nodes.groupBy("id").agg(F.min_by("label", "ord").alias("label"))
    for end in ("source", "target"):
        edges = edges.join(names.select(F.col("id").alias(f"__{end}"), F.col("label").alias(f"{end}_label")), F.col(end) == F.col(f"__{end}"), "left").drop(f"__{end}")
        edges = edges.withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    return edges


def neighbours(graph: Graph, node: str, most: int = 20) -> DataFrame:
    """``direction, id, label, relation, confidence``: the first links of a node, in edge order."""
    e = graph.edges.filter((F.col("source") == node) | (F.col("target") == node))
    out = F.col("source") == node
    rows = labelled(graph, e.orderBy("ord").limit(most))
    return rows.select(F.when(out, "out").otherwise("in").alias("direction"), F.when(out, F.col("target")).otherwise(F.col("source")).alias("id"), F.when(out, F.col("target_label")).otherwise(F.col("source_label")).alias("label"), "relation", F.initcap("confidence").alias("confidence"))


def find_node(graph: Graph, name: str) -> DataFrame:
    """The first node whose id is ``name`` or whose label is, whatever the case."""
    return graph.nodes.filter((F.col("id") == name) | (F.lower("label") == name.lower())).orderBy("ord").limit(1)


def node_details(graph: Graph, name: str) -> DataFrame:
    """``direction, id, label, relation, confidence, node_id, node_label, source_file, hyperedge``: a node's links with the node
    itself and its first hyperedge; one row with nulls in the links if it has none."""
    node = find_node(graph, name).select(F.col("id").alias("node_id"), F.col("label").alias("node_label"), "source_file")
    if graph.hyperedges is None:
        node = node.withColumn("hyperedge", F.lit(None).cast("string"))
    else:
        first = graph.members.groupBy("node_id").agg(F.min_by("he", "he_ord").alias("hyperedge"))
        node = node.join(first, "node_id", "left")
    e = labelled(graph, graph.edges.drop("source_file"))
    link = lambda own, other, said: node.join(e, F.col(own) == F.col("node_id")).select(F.lit(said).alias("direction"), F.col(other).alias("id"), F.col(f"{other}_label").alias("label"), "relation", F.initcap("confidence").alias("confidence"), *node.columns)
    links = link("source", "target", "out").union(link("target", "source", "in"))
    nothing = node.join(links.select("node_id").distinct(), "node_id", "left_anti").select(*[F.lit(None).cast("string").alias(c) for c in links.columns[:5]], *node.columns)
    return links.union(nothing)


def find_hyperedge(graph: Graph, name: str) -> DataFrame:
    return graph.hyperedges.filter((F.col("id") == name) | F.contains(F.lower("label"), F.lit(name.lower()))).orderBy("ord").limit(1)


def cohesion(graph: Graph) -> DataFrame:
    """``community, size, cohesion``: the share of pairs of a community's nodes that are linked, 1 for a single node."""
    member = graph.nodes.filter("community is not null").groupBy("id").agg(F.min_by("community", "ord").alias("community"))
    size = graph.nodes.filter("community is not null").groupBy("community").agg(F.count("*").alias("size"))
    pairs = graph.edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    a, b = (member.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
    inside = pairs.join(a, "a").join(b, "b").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("n"))
    share = F.coalesce("n", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2)
    return size.join(inside, "community", "left").select("community", "size", F.when(F.col("size") <= 1, 1.0).otherwise(rounded(share)).alias("cohesion"))


def community_info(graph: Graph, community: int) -> DataFrame:
    """``id, label, degree, community_label, size, cohesion`` of each member."""
    members = graph.nodes.filter(F.col("community") == community)
    stats = cohesion(Graph(members, graph.edges))
    return members.join(graph.incident, "id").crossJoin(F.broadcast(stats.select("size", "cohesion"))).select("id", "label", "degree", F.lit(f"Community {community}").alias("community_label"), "size", "cohesion")


def to_text(graph: Graph, nodes: DataFrame, edges: DataFrame, budget: int = 2000) -> str:
    """Nodes by degree, then the edges between them, cut to about ``budget`` tokens of four bytes."""
    shown = graph.nodes.join(nodes.select("id").distinct(), "id").join(graph.incident, "id")
    if graph.hyperedges is not None:
        first = graph.members.join(graph.hyperedges.select(F.col("id").alias("he"), F.col("label").alias("tag")), "he").groupBy(F.col("node_id").alias("id")).agg(F.min_by("tag", "he_ord").alias("tag"))
        shown = shown.join(first, "id", "left")
    else:
        shown = shown.withColumn("tag", F.lit(None).cast("string"))
    limit = 4 * budget  # a row takes more than four bytes, so no more than that many rows are shown
    lines = ["## Nodes"]
    for r in shown.orderBy(F.desc("degree"), "ord").limit(limit).collect():
        lines.append(f"  • {r.label}" + (f" [{r.tag}]" if r.tag else "") + f" [{r.source_file} @ {r.source_location}] (community: {r.community or 0})")
    lines += ["", "## Edges"]
    inside = edges.join(nodes.select(F.col("id").alias("s")).distinct(), F.col("source") == F.col("s"), "left_semi").join(nodes.select(F.col("id").alias("s")).distinct(), F.col("target") == F.col("s"), "left_semi")
    for r in labelled(graph, inside).orderBy("ord").limit(limit).collect():
        lines.append(f"  {r.source_label} --[{r.relation}: {r.confidence}]--> {r.target_label}")
    raw = "\n".join(lines).encode()
    return raw.decode() if len(raw) <= limit else raw[:limit].decode(errors="ignore") + f"\n... (truncated to ~{budget} token budget)"


def query(graph: Graph, question: str, depth: int = 3, budget: int = 2000, use_dfs: bool = False, **filters) -> str:
    """Text about what a question finds: its best nodes, and what is around them."""
    starts = cut(best(graph, question, **filters))
    labels = [r.label for r in starts.orderBy(F.desc("score"), "ord").collect()]
    if not labels:
        return "No matching nodes found" + (" with filters." if filters else ".")
    if use_dfs:
        walk = cut(dfs(graph, starts, depth))
        nodes = walk.filter("kind = 'node'").select(F.col("a").alias("id"))
        hops = walk.filter("kind = 'edge'").select(F.col("a").alias("source"), F.col("b").alias("target"))
        w = Window.partitionBy("source", "target").orderBy("ord")
        edges = hops.join(graph.edges.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"), ["source", "target"])
    else:
        nodes, edges = bfs(graph, starts, depth)
    head = f'Query: "{question}"\nTraversal: {"DFS" if use_dfs else "BFS"} depth={depth} | Start: {", ".join(labels)} | {nodes.count()} nodes found\n\n'
    return head + to_text(graph, nodes, edges, budget)


def explain(graph: Graph, name: str, most: int = 5) -> str:
    """A node with its first links out and in."""
    node = find_node(graph, name).first()
    if node is None:
        return f"Node '{name}' not found"
    out = [f"NODE: {node.label} ({node.id})", f"MODULE: {node.source_file}"]
    for title, end, other in (("CALLS", "source", "target"), ("CALLED BY", "target", "source")):
        rows = labelled(graph, graph.edges.filter(F.col(end) == node.id).orderBy("ord").limit(most)).orderBy("ord").collect()
        out += [f"{title}:"] + [f"  {r[f'{other}_label']} [{r.relation}, {r.confidence.title()}]" for r in rows]
    return "\n".join(out)
