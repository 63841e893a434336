"""What stands out in a graph: hubs, surprises, labels, gaps and questions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import capitalised, category, file_name, parent, rounded, top_dir
from ..plans.graph import AMBIGUOUS, EXTRACTED, INFERRED, Graph, doubtful_first, one_of
from ..plans.session import cut, numbered
from .query import cohesion, labelled

STRUCTURAL = ("contains", "imports", "imports_from", "method")
NOISE = tuple("args base common config controller core data handler helper index info init main manager model params service setup util view".split())
WHY = {
    AMBIGUOUS: "AMBIGUOUS connection - not explicitly stated in source",
    INFERRED: "INFERRED connection - model-reasoned relationship",
}


def confidence_counts() -> list[Column]:
    return [F.count_if(F.col("confidence") == c).alias(c.lower()) for c in (EXTRACTED, INFERRED, AMBIGUOUS)]


def confidence_stats(graph: Graph) -> DataFrame:
    return graph.edges.agg(*confidence_counts())


def confidence_pct(graph: Graph) -> DataFrame:
    """Whole percentages, rounded down; 0 without edges."""
    n = F.count("*")
    return graph.edges.agg(*[F.coalesce(F.expr(f"count_if(confidence = '{c}') * 100 div nullif(count(*), 0)"), F.lit(0)).alias(f"{c.lower()}_pct") for c in (EXTRACTED, INFERRED, AMBIGUOUS)], n.alias("total"))


def graph_stats(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count("*").alias("total_nodes"), F.count_distinct("community").alias("communities"))
    e = graph.edges.agg(F.count("*").alias("total_edges"), *confidence_counts())
    d = graph.incident.agg(F.sum("degree").alias("d"))
    average = F.when(F.col("total_nodes") > 0, rounded(F.col("d") / F.col("total_nodes"))).otherwise(0.0)
    return n.crossJoin(e).crossJoin(d).withColumn("avg_degree", average).drop("d")


def community_sizes(graph: Graph) -> DataFrame:
    return graph.nodes.filter("community is not null").groupBy("community").agg(F.count("*").alias("size"))


def is_file_node() -> Column:
    return F.col("label") == file_name("source_file")


def method_stub() -> Column:
    call = F.endswith("label", F.lit("()"))
    return call & (F.startswith("label", F.lit(".")) | (F.col("incident") <= 1))


def god_nodes(graph: Graph, n: int = 10) -> DataFrame:
    """``id, label, degree`` of the nodes with most edge ends, without file nodes and method stubs."""
    nodes = graph.nodes.join(graph.endpoints, "id").join(graph.incident.withColumnRenamed("degree", "incident"), "id")
    return nodes.filter(~is_file_node() & ~method_stub()).select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(n)


def most_connected(graph: Graph, n: int = 10) -> DataFrame:
    return graph.nodes.join(graph.incident, "id").orderBy(F.desc("degree"), "ord").select("id", "label", "degree").limit(n)


def god_neighbours(graph: Graph, n: int = 10, shown: int = 5) -> DataFrame:
    """``id, neighbours``: labels of the first links of each hub."""
    g = god_nodes(graph, n).select(F.col("id").alias("hub"))
    adj = graph.adjacent.join(F.broadcast(g), F.col("a") == F.col("hub")).join(graph.nodes.select(F.col("id").alias("b"), "label"), "b")
    w = Window.partitionBy("hub").orderBy("pos", "b")
    first = adj.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= shown)
    return first.groupBy(F.col("hub").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x.label), ", ").alias("neighbours"))


def _pairs(graph: Graph) -> DataFrame:
    """Edges that aren't structural between nodes that aren't files, with both ends' ``file``, ``comm`` and ``deg``."""
    n = graph.nodes.filter(~is_file_node()).join(graph.incident, "id")
    ends = []
    for p in "st":
        ends.append(n.select(F.col("id").alias(f"{p}_id"), F.col("source_file").alias(f"{p}_file"), F.coalesce("community", F.lit(0)).alias(f"{p}_comm"), F.col("degree").alias(f"{p}_deg")))
    e = graph.edges.filter(~F.col("relation").isin(*STRUCTURAL))
    return e.join(ends[0], F.col("source") == F.col("s_id")).join(ends[1], F.col("target") == F.col("t_id"))


def _scored(pairs: DataFrame) -> DataFrame:
    a, b = category("s_file"), category("t_file")
    crosses = (a != b) & (a != "other") & (b != "other")
    da, db = top_dir("s_file"), top_dir("t_file")
    apart = (da != "") & (db != "") & (da != db)
    bridges = F.col("s_comm") != F.col("t_comm")
    reach = ((F.col("s_deg") <= 2) & (F.col("t_deg") >= 5)) | ((F.col("t_deg") <= 2) & (F.col("s_deg") >= 5))
    score = one_of("confidence", {AMBIGUOUS: 3, INFERRED: 2}, 1) + 2 * crosses.cast("int") + 2 * apart.cast("int") + bridges.cast("int") + reach.cast("int")
    why = F.concat_ws("; ", one_of("confidence", WHY), F.when(crosses, F.concat(F.lit("crosses file types ("), a, F.lit(" → "), b, F.lit(")"))), F.when(apart, "connects across different directories/repos"), F.when(bridges, "bridges separate communities"), F.when(reach, "peripheral node unexpectedly reaches hub"))
    return pairs.withColumns({"score": score, "why": F.when(why == "", "cross-file semantic connection").otherwise(why)})


def cross_file_surprises(graph: Graph, n: int = 10) -> DataFrame:
    p = _pairs(graph).filter("s_file <> '' and t_file <> '' and s_file <> t_file")
    return _scored(p).orderBy(F.desc("score"), doubtful_first(), "ord").limit(n).select("source", "target", "relation", "confidence", "score", "why")


def cross_community_surprises(graph: Graph, n: int = 10) -> DataFrame:
    p = _pairs(graph).filter("s_comm <> t_comm")
    w = Window.partitionBy(F.least("s_comm", "t_comm"), F.greatest("s_comm", "t_comm")).orderBy("ord")
    first = p.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    return _scored(first).orderBy(doubtful_first(), "ord").limit(n).select("source", "target", "relation", "confidence", "score", "why")


def surprises(graph: Graph, n: int = 10) -> DataFrame:
    """Across files if there are several, else across communities."""
    files = graph.nodes.filter("source_file <> ''").select("source_file").distinct().limit(2).count()
    return cross_file_surprises(graph, n) if files > 1 else cross_community_surprises(graph, n)


def community_labels(graph: Graph) -> DataFrame:
    """``community, label``: the folder of at least half its nodes, else the most frequent word of its labels (ties: the least),
    else its number."""
    n = graph.nodes.filter("community is not null").select("community", "label", parent("source_file").alias("dir"))
    top = Window.partitionBy("community").orderBy(F.desc("n"), "x")
    most = lambda df: df.groupBy("community", "x").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(top)).filter("r = 1")
    dirs = most(n.filter("dir not in ('', '.')").select("community", F.col("dir").alias("x"))).select("community", F.col("x").alias("dir"), F.col("n").alias("n_dir"))
    long = lambda x: (F.octet_length(x) > 3) & ~x.isin(*NOISE)
    parts = F.filter(F.split(F.lower("label"), "_"), long)
    humps = F.regexp_extract_all("label", F.lit(r"(\p{Lu}[^\p{Lu}]*|^[^\p{Lu}]+)"), F.lit(1))
    camel = F.filter(F.transform(F.when(F.size(humps) > 1, F.slice(humps, 1, F.size(humps) - 1)).otherwise(F.array().cast("array<string>")), F.lower), long)
    words = most(n.select("community", F.explode(F.concat(parts, camel)).alias("x"))).select("community", F.col("x").alias("word"))
    folder = F.array_join(F.transform(F.split(F.element_at(F.split("dir", "/"), -1), "_"), capitalised), "")
    label = F.coalesce(F.when(F.col("n_dir") * 2 >= F.col("size"), folder), capitalised(F.col("word")), F.concat(F.lit("Community "), "community"))
    return community_sizes(graph).join(dirs, "community", "left").join(words, "community", "left").select("community", label.alias("label"))


def isolated(graph: Graph) -> DataFrame:
    """``id, label, degree, ord`` of nodes with at most one edge that aren't files."""
    return graph.nodes.join(graph.incident, "id").filter(~is_file_node() & (F.col("degree") <= 1)).select("id", "label", "degree", "ord")


def ambiguous_edges(graph: Graph) -> DataFrame:
    return labelled(graph, graph.edges.filter(F.col("confidence") == AMBIGUOUS)).select("source", "target", "relation", "source_label", "target_label", "ord")


def thin_communities(graph: Graph, below: int = 3) -> DataFrame:
    return community_sizes(graph).filter(F.col("size") < below)


def _shortest(source: int, starts: np.ndarray, near: np.ndarray, total: np.ndarray) -> None:
    """Brandes' accumulation from one source."""
    order, before, count, dist = [source], {source: []}, {source: 1.0}, {source: 0}
    for v in order:  # grows while it is walked
        for w in near[starts[v] : starts[v + 1]].tolist():
            if w not in dist:
                dist[w], count[w], before[w] = dist[v] + 1, 0.0, []
                order.append(w)
            if dist[w] == dist[v] + 1:
                count[w] += count[v]
                before[w].append(v)
    share = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before[w]:
            share[v] += count[v] / count[w] * (1 + share[w])
        if w != source:
            total[w] += share[w]


def _stacked(source: int, starts: np.ndarray, near: np.ndarray, total: np.ndarray) -> None:
    """Paths that a last-in-first-out walk from one source hands on: at its first visit a node gives all it has to each link's unvisited end."""
    stack, seen, paths = [source], set(), {source: 1.0}
    while stack:
        v = stack.pop()
        if v in seen:
            continue
        seen.add(v)
        for w in near[starts[v] : starts[v + 1]].tolist():
            if w not in seen:
                paths[w] = paths.get(w, 0.0) + paths[v]
                stack.append(w)
    for w, n in paths.items():
        if w != source:
            total[w] += n


def _walks(walk: Callable, starts: np.ndarray, near: np.ndarray, sources: Iterable[int]) -> np.ndarray:
    """What walks from the sources add up to for each node."""
    total = np.zeros(len(starts) - 1)
    for source in sources:
        walk(source, starts, near, total)
    return total


def betweenness(graph: Graph, held: int = 20_000_000, mode: str = "shortest") -> DataFrame:
    """``id, score`` of each node, scaled by 2 / ((n - 1)(n - 2)): with ``mode`` 'shortest' Brandes' betweenness over undirected links, with
    'path_count' the paths that end at a node in depth-first walks from all nodes, repeated links counting again.

    Nodes become numbers and links integer arrays, four bytes a link and eight a node, which are broadcast; a task makes Python numbers only of
    the links that it follows.  Sources are spread over tasks.  More
    than ``held`` links between nodes, or nodes, are refused.  Ids without a node have no score and lead nowhere."""
    if mode not in ("shortest", "path_count"):
        raise ValueError(f"mode = {mode!r}")
    spark = graph.nodes.sparkSession
    ids = numbered(graph.nodes.select("id").distinct(), "i", "id")
    a, b = (ids.select(F.col("id").alias(x), F.col("i").cast("int").alias(f"i{x}")) for x in "ab")
    links = graph.adjacent if mode == "path_count" else graph.adjacent.groupBy("a", "b").agg(F.min("pos").alias("pos"))
    links = cut(links.filter("a <> b").join(a, "a").join(b, "b").select("ia", "ib", "pos"))
    n = ids.count()
    if links.count() > held or n > held:
        raise ValueError(f"more than {held} links or nodes: betweenness holds them in each task")
    table = links.toArrow()
    near = {c: table.column(c).to_numpy() for c in ("ia", "ib", "pos")}
    order = np.lexsort((near["ib"], near["pos"], near["ia"]))
    starts = np.searchsorted(near["ia"][order], np.arange(n + 1)).astype(np.int64)
    sent = spark.sparkContext.broadcast((starts, near["ib"][order].astype(np.int32)))
    walk = _shortest if mode == "shortest" else _stacked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _walks(walk, *sent.value, (source for batch in batches for source in batch.column(0).to_pylist()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "s"])

    # every pair is met from both of its ends, which Brandes' counts halve
    scale = (0.5 if mode == "shortest" else 1.0) / comb(n - 1, 2) if n > 2 else 0.5 if mode == "shortest" else 1.0
    parts = ids.select("i").repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(run, "i long, s double")
    return ids.join(parts.groupBy("i").agg(F.sum("s").alias("s")), "i", "left").select("id", (F.coalesce("s", F.lit(0.0)) * scale).alias("score"))


@dataclass(frozen=True)
class Analysis:
    """What ``analyze`` finds, each a DataFrame."""

    god_nodes: DataFrame
    surprising_connections: DataFrame
    community_sizes: DataFrame
    cohesion_scores: DataFrame
    community_labels: DataFrame
    confidence_stats: DataFrame

    def rows(self) -> DataFrame:
        """``section, key, value``: all of it but the surprises, as text."""
        text = lambda df, section, key, value: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
        counts = self.confidence_stats.select(F.explode(F.create_map(*[x for c in self.confidence_stats.columns for x in (F.lit(c), F.col(c))])).alias("k", "v"))
        return (
            text(self.god_nodes, "god", "id", "degree").union(text(self.community_sizes, "size", "community", "size"))
            .union(text(self.cohesion_scores.withColumn("percent", F.round(F.col("cohesion") * 100).cast("long")), "cohesion", "community", "percent"))
            .union(text(self.community_labels, "label", "community", "label")).union(text(counts, "confidence", "k", "v"))
        )


def analyze(graph: Graph) -> Analysis:
    """Hubs, surprises, sizes, cohesion and labels of communities, and confidence counts of a graph."""
    return Analysis(god_nodes(graph), surprises(graph), community_sizes(graph), cohesion(graph), community_labels(graph), confidence_stats(graph))


def questions(graph: Graph, n: int = 7, bridges: bool = True) -> DataFrame:
    """``pos, question_type, question, why``: questions that the graph raises, at most ``n``; one row without signal."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    kinds = []

    def add(df: DataFrame, kind: str, question: Column, why: Column, order: list) -> None:
        made = df.select(F.lit(len(kinds)).alias("k"), F.struct(*order).cast("string").alias("o0"), *[x.alias(f"o{i + 1}") for i, x in enumerate(order[:1])], F.lit(kind).alias("question_type"), question.alias("question"), why.alias("why"))
        kinds.append(made.orderBy("o1", "o0").limit(n).select("k", F.col("o1").cast("double").alias("o"), "o0", "question_type", "question", "why"))

    amb = ambiguous_edges(graph)
    add(amb, "ambiguous_edge", F.concat(F.lit("What is the exact relationship between "), tick("source_label"), F.lit(" and "), tick("target_label"), F.lit("?")), F.concat(F.lit("Edge tagged AMBIGUOUS (relation: "), "relation", F.lit(") - confidence is low.")), [F.col("ord")])
    labels = community_labels(graph)
    if bridges:
        score = betweenness(graph).filter("score > 0").orderBy(F.desc("score"), "id").limit(10)
        names = graph.nodes.filter(~is_file_node()).select("id", "label", "community")
        other = graph.adjacent.join(F.broadcast(score), F.col("a") == score["id"]).select("a", "b", "score").join(names.select(F.col("id").alias("a"), "label", F.col("community").alias("own")), "a").join(graph.nodes.select(F.col("id").alias("b"), "community"), "b").filter("community is not null and not community <=> own").join(labels.withColumnRenamed("label", "there"), "community")
        each = other.groupBy("a", "label", "own", "score").agg(F.array_join(F.array_sort(F.collect_set(tick("there"))), ", ").alias("others")).join(labels.select(F.col("community").alias("own"), F.col("label").alias("here")), "own", "left")
        add(each, "bridge_node", F.concat(F.lit("Why does "), tick("label"), F.lit(" connect "), tick(F.coalesce("here", F.lit("unknown"))), F.lit(" to "), "others", F.lit("?")), F.concat(F.lit("High betweenness centrality ("), F.format_number("score", 6), F.lit("): it bridges communities.")), [-F.col("score"), F.col("a")])
    hubs = F.broadcast(god_nodes(graph, 5).select(F.col("id").alias("hub"), F.col("label").alias("hub_label"), "degree"))
    inferred = labelled(graph, graph.edges.filter(F.col("confidence") == INFERRED)).join(hubs, (F.col("source") == F.col("hub")) | (F.col("target") == F.col("hub")))
    far = F.when(F.col("source") == F.col("hub"), F.col("target_label")).otherwise(F.col("source_label"))
    w = Window.partitionBy("hub")
    ranked = inferred.withColumns({"far": far, "i": F.row_number().over(w.orderBy("ord")), "c": F.count("*").over(w)}).filter("i <= 2 and c >= 2")
    per = ranked.groupBy("hub", "hub_label", "degree", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "far"))), lambda x: tick(x.far)), " and ").alias("others"))
    add(per, "verify_inferred", F.concat(F.lit("Are the "), "c", F.lit(" inferred relationships of "), tick("hub_label"), F.lit(" (e.g. with "), "others", F.lit(") actually correct?")), F.concat(tick("hub_label"), F.lit(" has "), "c", F.lit(" INFERRED edges that need verification.")), [-F.col("degree"), F.col("hub")])
    alone = isolated(graph).orderBy("ord").limit(3).agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("x")).filter(F.size("x") > 0)
    add(alone, "isolated_nodes", F.concat(F.lit("What connects "), F.array_join(F.transform("x", lambda v: tick(v.label)), ", "), F.lit(" to the rest of the system?")), F.concat(F.size("x"), F.lit(" weakly-connected nodes found: documentation gaps or missing edges.")), [F.lit(0)])
    loose = cohesion(graph).filter("cohesion < 0.15 and size >= 5").join(labels, "community")
    add(loose, "low_cohesion", F.concat(F.lit("Should "), tick("label"), F.lit(" be split into smaller, more focused modules?")), F.concat(F.lit("Cohesion score "), F.format_number("cohesion", 2), F.lit(": its nodes are weakly interconnected.")), [F.col("community")])
    out = kinds[0]
    for k in kinds[1:]:
        out = out.union(k)
    first = cut(out.orderBy("k", "o", "o0").limit(n))
    if first.isEmpty():
        return graph.nodes.sparkSession.createDataFrame([(0, "no_signal", "", "Nothing in this graph raises a question.")], "pos long, question_type string, question string, why string")
    return first.select((F.row_number().over(Window.orderBy("k", "o", "o0")) - 1).cast("long").alias("pos"), "question_type", "question", "why")
