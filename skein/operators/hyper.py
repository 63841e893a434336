"""Groups of nodes: by file, configuration type and folder, and along call chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.paths import extension, file_stem, last_dir, parent
from ..plans.components import components as linked
from ..plans.graph import INFERRED, Graph
from ..plans.session import cut, numbered
from .cluster import between

LEAST, MOST, LEAST_SCORE = 3, 20, 0.3
CONFIG = ("dockerfile", "json", "tf", "toml", "yaml", "yml")
COLUMNS = ("id", "label", "nodes", "relation", "confidence", "confidence_score", "source_file", "rank", "ord")


def group_cohesion(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``g, score`` for groups ``g, nodes``: internal edges of a group over all that touch it, 0.5 without any."""
    m = groups.select("g", F.explode("nodes").alias("id")).distinct()
    e = edges.select("source", "target", "relation", "ord")
    touch = e.join(m, F.col("source") == F.col("id")).select("g", *e.columns, F.lit(1).alias("n")).union(e.join(m, F.col("target") == F.col("id")).select("g", *e.columns, F.lit(1)))
    per = touch.groupBy("g", *e.columns).agg(F.sum("n").alias("n"))
    score = per.groupBy("g").agg((F.count_if(F.col("n") == 2) / F.count("*")).alias("score"))
    return groups.select("g").join(score, "g", "left").select("g", F.coalesce("score", F.lit(0.5)).alias("score"))


def chain_cohesion(chains: DataFrame, graph: Graph) -> DataFrame:
    """``c, score`` of chains ``c, nodes``: the share of their steps that are edges, in either direction, and 0.1 more if the first and
    the last node are of one file, at most 1; 0.5 for chains of fewer than two nodes."""
    n = F.size("nodes")
    steps = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.element_at("nodes", i).alias("x"), F.element_at("nodes", i + 1).alias("y"))))
    e = graph.edges.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct().withColumn("there", F.lit(1))
    step = chains.select("c", F.explode(steps).alias("s")).select("c", F.least("s.x", "s.y").alias("lo"), F.greatest("s.x", "s.y").alias("hi"))
    share = step.join(e, ["lo", "hi"], "left").groupBy("c").agg((F.count("there") / F.count("*")).alias("share"))
    file = graph.nodes.groupBy("id").agg(F.min_by("source_file", "ord").alias("f"))
    ends = chains.filter(n > 1).select("c", F.element_at("nodes", 1).alias("first"), F.element_at("nodes", -1).alias("last"))
    ends = ends.join(file.select(F.col("id").alias("first"), F.col("f").alias("f1")), "first").join(file.select(F.col("id").alias("last"), F.col("f").alias("f2")), "last")
    scored = chains.select("c").join(share, "c", "left").join(ends.select("c", (F.col("f1") == F.col("f2")).alias("same")), "c", "left")
    bonus = F.when(F.col("same"), 0.1).otherwise(0.0)
    return scored.select("c", F.when(F.col("share").isNull(), 0.5).otherwise(F.least(F.col("share") + bonus, F.lit(1.0))).alias("score"))


def _grouped(graph: Graph, key: Column, keep: Column, least: int, most: int, id_: Column, label: Column, relation: str, rank: int, extra: Column | None = None) -> DataFrame:
    """Groups by a key.  Only those of ``least`` to ``most`` nodes are collected; larger ones are no more than counted."""
    n = graph.nodes.withColumn("g", key).filter(keep)
    g = n.groupBy("g").agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.min_by("source_file", "ord").alias("source_file"), F.count_distinct(parent("source_file")).alias("dirs"))
    g = g.filter(F.col("n").between(least, most))
    if extra is not None:
        g = g.filter(extra)
    g = cut(g)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"])
    g = g.join(n.join(g.select("g"), "g", "left_semi").groupBy("g").agg(ids.alias("nodes")), "g")
    scored = g.join(group_cohesion(g, graph.edges), "g")
    return scored.select(id_.alias("id"), label.alias("label"), "nodes", F.lit(relation).alias("relation"), F.lit(INFERRED).alias("confidence"), F.col("score").alias("confidence_score"), "source_file", F.lit(rank).alias("rank"), "ord")


def file_groups(graph: Graph) -> DataFrame:
    """Nodes of one file.  Files of more than 20 nodes could only hide equal sets, which are as large, so they are left out here."""
    stem = F.translate(F.lower(file_stem("g")), " ", "_")
    return _grouped(graph, F.col("source_file"), F.lit(True), LEAST, MOST, F.concat(F.lit("file_"), stem), F.concat(file_stem("g"), F.lit(" module")), "participate_in", 0)


def config_groups(graph: Graph) -> DataFrame:
    key = extension("source_file")
    return _grouped(graph, key, key.isin(*CONFIG), LEAST, MOST, F.concat(F.lit("config_"), "g"), F.concat(F.lit("Config files (."), "g", F.lit(")")), "config_group", 2)


def dir_groups(graph: Graph) -> DataFrame:
    """Nodes of one folder: at least six, and all folders of that name are the same."""
    key = last_dir("source_file")
    keep = ~key.isin("", "root") & ~F.startswith(key, F.lit("."))
    return _grouped(graph, key, keep, 2 * LEAST, MOST, F.concat(F.lit("dir_"), F.lower("g")), F.concat("g", F.lit(" directory")), "directory_module", 3, F.col("dirs") == 1)


def _nulls_first(x: int | None) -> tuple[bool, int]:
    return x is not None, x or 0


def _walked(next_: list[list[int]], start: int, most: int) -> Iterator[list[int]]:
    """Every simple path of two to ``most`` nodes from a node, depth first, as one list that changes."""
    path, on, todo = [start], {start}, [iter(next_[start])]
    while todo:
        for w in todo[-1]:
            if w not in on:
                path.append(w)
                yield path
                if len(path) < most:
                    on.add(w)
                    todo.append(iter(next_[w]))
                    break
                path.pop()
        else:
            todo.pop()
            on.discard(path.pop())


class _Part:
    """A component: its nodes with ``ord`` and ``source_file``, and for each the nodes that it calls, in order."""

    def __init__(self, nodes: list[tuple], links: list[tuple]) -> None:
        self.ids, self.ord, self.file = (list(x) for x in zip(*nodes)) if nodes else ([], [], [])
        at = {x: i for i, x in enumerate(self.ids)}
        near: list[list[tuple]] = [[] for _ in self.ids]
        first: dict[tuple, int | None] = {}
        for a, b, pos in links:
            link = at[a], at[b]
            if link not in first or _nulls_first(pos) < _nulls_first(first[link]):
                first[link] = pos
        for (a, b), pos in first.items():
            near[a].append((pos, b))
        self.next = [[w for _, w in sorted(x, key=lambda y: (*_nulls_first(y[0]), y[1]))] for x in near]
        self.pos = [{w: p for p, w in x} for x in near]
        self.tied = any(len({p for p, _ in x}) < len(x) for x in near)

    def key(self, path: list[int]) -> list[int]:
        return [self.ord[path[0]], *[self.pos[a][b] for a, b in zip(path, path[1:])]]

    def chains(self, start: int, most: int) -> Iterator[list[int]]:
        """The chains from a node by key, of equals by ids: that is the walk's own order, unless a node's calls share a place."""
        found = (path for path in _walked(self.next, start, most) if len(path) >= LEAST)
        if not self.tied:
            return found
        return iter(sorted((path[:] for path in found), key=lambda p: ([_nulls_first(k) for k in self.key(p)], [self.ids[i] for i in p])))


def _by_part(rows: DataFrame, each: Callable[[_Part], Iterator[tuple]], schema: str, at_once: int = 10_000) -> DataFrame:
    """``each`` over the components of rows ``root, a, b, pos, source_file`` (``b`` null for a node's own row, whose ``pos`` is its ``ord``), which come
    together.  A task holds one component at a time, and ``at_once`` rows of what it gives."""
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[_Part]:
            now, nodes, links = None, [], []
            for batch in batches:
                for root, a, b, pos, file in zip(*(c.to_pylist() for c in batch.columns)):
                    if root != now:
                        if nodes:
                            yield _Part(nodes, links)
                        now, nodes, links = root, [], []
                    if b is None:
                        nodes.append((a, pos, file))
                    else:
                        links.append((a, b, pos))
            if nodes:
                yield _Part(nodes, links)

        made = (row for part in parts() for row in each(part))
        while rows_ := list(islice(made, at_once)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows_), kinds)], schema=kinds)

    return rows.mapInArrow(run, schema)


def _parts(graph: Graph, max_rows: int, most: int, held: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Rows of components of at most ``held`` calls for ``_by_part``, the calls of larger ones if there are any, and the nodes.  Fails
    if one component has more than ``max_rows`` paths of a length."""
    starts = graph.nodes.groupBy("id").agg(F.min("ord").alias("ord"), F.min_by("source_file", "ord").alias("source_file"))
    calls = graph.edges.filter("relation = 'calls' and source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("ord").alias("pos"))
    e = between(calls, graph.nodes.select("id").distinct())
    roots = cut(linked(e.select("a", "b")).withColumnRenamed("node", "a"))
    e = e.join(roots, "a")
    large = cut(e.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > held).select("root"))
    beyond = None
    if not large.isEmpty():
        beyond = cut(e.join(large, "root").groupBy("a", "b").agg(F.min("pos").alias("pos")))
        e, roots = e.join(large, "root", "left_anti"), roots.join(large, "root", "left_anti")
    own = starts.withColumnRenamed("id", "a").join(roots, "a").select("root", "a", F.lit(None).cast("string").alias("b"), F.col("ord").alias("pos"), "source_file")
    rows = own.union(e.select("root", "a", "b", "pos", F.lit(None).cast("string")))
    rows = cut(rows.repartition(max(int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "root").sortWithinPartitions("root"))

    def count(part: _Part) -> Iterator[tuple]:
        n = [0] * (most + 1)
        for start in range(len(part.ids)):
            for path in _walked(part.next, start, most):
                n[len(path)] += 1
                if n[len(path)] > max_rows:
                    yield (len(path),)
                    return

    over = _by_part(rows, count, "n int").first()
    if over is not None:
        raise ValueError(f"more than {max_rows} paths of {over[0]} nodes")
    return rows, beyond, starts


def _joined(e: DataFrame, starts: DataFrame, most: int, max_rows: int) -> DataFrame:
    """``nodes, key, source_file`` of the chains along ``a, b, pos``, by a join each round."""
    paths = starts.select(F.array("id").alias("nodes"), F.array(F.col("ord")).alias("key"), "source_file")
    e = e.select(F.col("a").alias("source"), F.col("b").alias("target"), "pos")
    out = None
    for length in range(2, most + 1):
        last = paths.withColumn("source", F.element_at("nodes", -1))
        grown = last.join(e, "source").filter(~F.array_contains("nodes", F.col("target"))).select(F.array_append("nodes", F.col("target")).alias("nodes"), F.array_append("key", F.col("pos")).alias("key"), "source_file")
        paths = cut(grown)
        n = paths.count()
        if n > max_rows:
            raise ValueError(f"more than {max_rows} paths of {length} nodes")
        if n == 0:
            break
        if length >= LEAST:
            out = paths if out is None else out.union(paths)
    return paths.limit(0) if out is None else out


def call_chains(graph: Graph, most: int = MOST, max_rows: int = 50_000_000, held: int = 10_000) -> DataFrame:
    """Every simple directed path over ``calls`` edges of 3 to ``most`` nodes: ``nodes, key, n_nodes, source_file``; by ``key`` they are in
    the order of a depth-first search.

    A path lies in one component, so a component of at most ``held`` calls is searched in one task, and none of its paths is
    shuffled or written.  In larger ones paths grow by a join each round.  Their number can be exponential: where a component, or the larger
    ones in a round, have more than ``max_rows`` paths of a length this fails rather than leave some out."""
    rows, beyond, starts = _parts(graph, max_rows, most, held)

    def each(part: _Part) -> Iterator[tuple]:
        for start, file in enumerate(part.file):
            for path in part.chains(start, most):
                yield [part.ids[i] for i in path], part.key(path), file

    out = _by_part(rows, each, "nodes array<string>, key array<bigint>, source_file string")
    if beyond is not None:
        out = out.union(_joined(beyond, starts, most, max_rows))
    return out.select("nodes", "key", F.size("nodes").cast("long").alias("n_nodes"), "source_file")


def chain_candidates(graph: Graph, most: int = MOST, max_rows: int = 50_000_000, held: int = 10_000) -> DataFrame:
    """Chains as candidates; each step is an edge, so their cohesion is 1.  ``chain_<n>`` and ``ord`` are a chain's place in the search order.

    One chain of each member set is all that later dedup keeps, the first in search order.  Its place is that among the chains from its first node, after
    all chains from nodes before that one; so only these first ones, and how many chains each node begins, leave a component.  Where
    components are large, or nodes share an ``ord`` or have none, all chains are numbered instead."""
    rows, beyond, starts = _parts(graph, max_rows, most, held)
    own = rows.filter("b is null")
    if beyond is not None or not own.groupBy("pos").count().filter("count > 1 or pos is null").isEmpty():
        chains = numbered(call_chains(graph, most, max_rows, held), "n", "key", "nodes")
        members = F.array_join(F.array_sort("nodes"), "|")
        first = chains.groupBy(members.alias("m")).agg(F.min(F.struct("n", "nodes", "source_file")).alias("x")).select("x.*")
    else:

        def each(part: _Part) -> Iterator[tuple]:
            met = set()
            for start in sorted(range(len(part.ids)), key=part.ord.__getitem__):
                n = 0
                for path in part.chains(start, most):
                    members = frozenset(path)
                    if members not in met:
                        met.add(members)
                        yield part.ord[start], n, [part.ids[i] for i in path], part.file[start]
                    n += 1
                yield part.ord[start], n, None, None

        found = cut(_by_part(rows, each, "start bigint, i bigint, nodes array<string>, source_file string"))
        begin = _running(found.filter("nodes is null and i > 0").select("start", F.col("i").alias("count")))
        first = found.filter("nodes is not null").join(begin, "start").select((F.col("begin") + F.col("i")).alias("n"), "nodes", "source_file")
    return first.select(F.concat(F.lit("chain_"), "n").alias("id"), F.concat(F.lit("Flow: "), F.array_join("nodes", " → ")).alias("label"), "nodes", F.lit("flow").alias("relation"), F.lit(INFERRED).alias("confidence"), F.lit(1.0).alias("confidence_score"), "source_file", F.lit(1).alias("rank"), F.col("n").alias("ord"))


def _running(counts: DataFrame) -> DataFrame:
    """``start, begin`` of distinct ``start, count``: the sum of the counts before each."""
    placed = cut(counts.repartitionByRange("start").withColumn("p", F.spark_partition_id()))
    begin, rows = 0, []
    for p, n in sorted(tuple(r) for r in placed.groupBy("p").agg(F.sum("count")).collect()):  # one row a partition
        rows.append((p, begin))
        begin += n
    base = counts.sparkSession.createDataFrame(rows, "p int, base long")
    before = F.sum("count").over(Window.partitionBy("p").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("s", F.coalesce(before, F.lit(0))).join(F.broadcast(base), "p").select("start", (F.col("s") + F.col("base")).alias("begin"))


def process(candidates: DataFrame) -> DataFrame:
    """The first candidate of each set of members, if its score is at least 0.3 and it has 3 to 20.  ``ord`` is its place by score, the highest
    first, then kind, then the kind's own order; of equals, by id."""
    w = Window.partitionBy(F.array_join(F.array_sort("nodes"), "|")).orderBy("rank", "ord", "id")
    kept = candidates.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    kept = kept.filter((F.col("confidence_score") >= LEAST_SCORE) & F.size("nodes").between(LEAST, MOST))
    return numbered(kept.withColumnRenamed("ord", "own"), "ord", F.desc("confidence_score"), "rank", "own", "id").select(*[c for c in candidates.columns])


def detect(graph: Graph, chains: bool = True) -> DataFrame:
    """Hyperedges of all four kinds, ranked as in ``process``."""
    found = file_groups(graph)
    if chains:
        found = found.union(chain_candidates(graph))
    return process(found.union(config_groups(graph)).union(dir_groups(graph)).select(*COLUMNS))
