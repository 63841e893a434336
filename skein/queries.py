"""Every operator as a query over the tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .operators import analyze as A
from .operators import build as B
from .operators import cluster as C
from .operators import extract as X
from .operators import hyper as H
from .operators import query as Q
from .operators.report import report_lines
from .plans.graph import Graph
from .plans.session import cut
from .sources import files as S
from .sources import cache as K
from .sources.tables import histories, sessions, sessions_raw, shelves, source_files, table, trade, web

CUT = "1996-01-01"
QUESTION = "the supplier Supplier#000000007 and part near asia"
#: Source texts by extension; @ is a number.
SOURCES = {
    "rs": "// fn hidden()\nstruct Box@;\nimpl Box@ {\n  fn new() -> Box@ { make@(\"fn str()\") }\n}\nfn make@(s: &str) { helper(s) }\n",
    "go": "package p\nimport (\n  \"fmt\"\n  \"lib/u@\"\n)\nfunc Run@() {\n  fmt.Print(\"x\")\n}\nfunc Main@() { Run@() }\n",
    "js": "import {z} from \"../lib/z@\";function aa@(){bb@()}function bb@(){cc(1)}\n/* function no() {} */\n",
    "rb": "require \"set\"\ndef match(x)\n  grow@(x)\nend\nmatch(1) # call(2)\n",
    "java": "import a.b.C@;\npublic class Two@ { int one@(int x) { return more(x); } int more(int y) { if (y > 0) { return 1; } return one@(2); } }\n",
    "py": "from . import x@\nfrom a.b import c\nclass Kind@:\n    def go(self):\n        run@()\n",
}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def on(make: Callable[[SparkSession, str], Graph], *operators: tuple[str, Callable[[Graph], DataFrame]]) -> None:
    for name, f in operators:
        QUERIES[name] = lambda spark, sf_dir, f=f, make=make: f(make(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    """The trade graph before and after a date, and without the odd customers before."""
    day = F.lit(CUT).cast("timestamp")
    old, new = trade(spark, sf_dir, F.col("l_shipdate") < day), trade(spark, sf_dir, F.col("l_shipdate") >= day)
    even = "not (node_type = 'customer' and ord % 2 = 1)"
    return Graph(old.nodes.filter(even), old.edges), Graph(new.nodes.filter("node_type <> 'region'"), new.edges)


def with_groups(spark: SparkSession, sf_dir: str) -> Graph:
    g = sessions(spark, sf_dir)
    return g.with_hyperedges(H.file_groups(g))


@query
def query_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the best nodes for a question, three steps around them, with labels and degrees."""
    g = trade(spark, sf_dir)
    nodes, _ = Q.bfs(g, Q.best(g, QUESTION), 2)
    return nodes.join(g.nodes.select("id", "label", "source_file"), "id").join(g.incident, "id").select("id", "label", "source_file", F.col("level").cast("long").alias("level"), "degree")


on(
    trade,
    ("graph_stats", A.graph_stats),
    ("confidence_stats", A.confidence_stats),
    ("confidence_pct", A.confidence_pct),
    ("god_nodes", A.god_nodes),
    ("god_neighbours", A.god_neighbours),
    ("most_connected", A.most_connected),
    ("community_sizes", A.community_sizes),
    ("surprises_cross_file", A.cross_file_surprises),
    ("surprises_cross_community", A.cross_community_surprises),
    ("community_labels", A.community_labels),
    ("isolated_nodes", lambda g: A.isolated(g).drop("ord")),
    ("ambiguous_edges", lambda g: A.ambiguous_edges(g).drop("ord")),
    ("score_nodes", lambda g: Q.score_nodes(g, Q.terms(QUESTION)).select("id", "score")),
    ("score_filtered", lambda g: Q.filtered(Q.score_nodes(g, Q.terms(QUESTION)), g, node_type="SUPP", community=7, source="n7").select("id", "score")),
    ("neighbors", lambda g: Q.neighbours(g, "nation:7", 20)),
    ("bfs_nodes", lambda g: Q.bfs(g, g.nodes.filter("id = 'nation:3'"), 2)[0].select("id", F.col("level").cast("long").alias("level"))),
    ("bfs_edges", lambda g: Q.bfs(g, g.nodes.filter("id = 'supplier:5'"), 2)[1].select("source", "target", "relation", "confidence")),
    ("questions_ambiguous", lambda g: A.questions(g, 7, bridges=False)),
)
on(
    sessions,
    ("degree_endpoints", lambda g: g.endpoints),
    ("degree_incident", lambda g: g.incident),
    ("file_groups", lambda g: _groups(H.file_groups(g))),
    ("dir_groups", lambda g: _groups(H.dir_groups(g))),
    ("group_cohesion", lambda g: H.group_cohesion(g.nodes.groupBy(F.col("label").alias("g")).agg(F.collect_list("id").alias("nodes")), g.edges)),
    ("call_chains", lambda g: H.call_chains(g).select(F.array_join("nodes", ">").alias("chain"), "n_nodes", "source_file")),
    ("hyperedges", lambda g: _groups(H.detect(g)).select("members", "relation", "confidence_score")),
    ("community_cohesion", Q.cohesion),
    ("thin_communities", lambda g: A.thin_communities(g, 6)),
    ("connected_components", C.components),
    ("community_info", lambda g: Q.community_info(g, 7)),
    ("shortest_path", lambda g: Q.path_rows(g, _first(g), _last(g), 8)),
    ("leiden", C.leiden),
    ("split_oversized", lambda g: C.split_oversized(Graph(g.nodes.withColumn("community", F.expr("community div 10")), g.edges), 25)),
    ("dfs", lambda g: Q.dfs(g, g.nodes.filter("community = 7").orderBy("ord").limit(1), 3)),
    ("betweenness", A.betweenness),
    ("questions", lambda g: A.questions(Graph(g.nodes.withColumn("community", (F.col("ord") % 7).cast("int")), g.edges), 20)),
)


on(
    shelves,
    ("components_deep", C.components),
    ("bfs_deep", lambda g: Q.bfs(g, g.nodes.orderBy("ord").limit(1), 3)[0].select("id", F.col("level").cast("long").alias("level"))),
    ("shortest_path_deep", lambda g: Q.path_rows(g, *_ends(g), 8)),
    ("cohesion_deep", Q.cohesion),
)
on(
    histories,
    ("components_histories", C.components),
    ("call_chains_deep", lambda g: H.call_chains(g).select(F.element_at("nodes", 1).alias("first"), F.element_at("nodes", -1).alias("last"), "n_nodes", "source_file")),
)


def _ends(g: Graph) -> tuple[str, str]:
    """The first part, and the one that five steps along its brand lead to."""
    at = first = g.nodes.orderBy("ord").first()["id"]
    for _ in range(5):
        step = g.edges.filter((F.col("relation") == "p_brand") & (F.col("source") == at)).first()
        at = step["target"] if step else at
    return first, at


def _first(g: Graph) -> str:
    return g.edges.filter("source <> target").agg(F.min("source")).first()[0]


def _last(g: Graph) -> str:
    start = _first(g)
    return g.edges.filter(F.split_part("source", F.lit(":"), F.lit(1)) == start.split(":")[0]).agg(F.max("target")).first()[0]


def _groups(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "label", F.array_join(F.array_sort("nodes"), ",").alias("members"), "relation", "confidence_score", *more)


@query
def config_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as if each nation's were described by a configuration file."""
    g = trade(spark, sf_dir)
    n = g.nodes.filter("node_type in ('supplier', 'nation', 'region')").withColumn("source_file", F.concat(F.lit("cfg/"), F.col("ord") % 400, F.lit("."), F.when(F.col("ord") % 400 < 4, "yaml").when(F.col("ord") % 400 < 10, "toml").otherwise("TF")))
    return _groups(H.config_groups(Graph(n, g.edges)))


@query
def node_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = with_groups(spark, sf_dir)
    return Q.node_details(g, _first(g))


@query
def hyperedge_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find_hyperedge(with_groups(spark, sf_dir), "U7 MOD").select("id", "label", F.array_join(F.array_sort("nodes"), ",").alias("members"))


@query
def score_by_hyperedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = with_groups(spark, sf_dir)
    return Q.filtered(Q.score_nodes(g, ["click", "log"]), g, hyperedge="u1").select("id", "score")


@query
def dedup_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = trade(spark, sf_dir).nodes
    again = n.withColumns({"label": F.lower("label"), "ord": F.col("ord") + 10**15}).union(n.filter("ord % 3 = 0").withColumns({"label": F.upper("label"), "ord": F.col("ord") - 10**15}))
    return B.first_of(n.union(again), "id").select("id", "label", "ord")


@query
def dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.first_of(sessions_raw(spark, sf_dir), "source", "target", "relation").select("source", "target", "relation", "ord")


@query
def merge_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return B.merge(old, new).edges.select("source", "target", "relation", "confidence")


@query
def merge_into_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = B.merge_into(*snapshots(spark, sf_dir))
    return g.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("label").alias("b")).union(g.edges.select(F.lit("edge"), F.concat("source", F.lit(">"), "target"), "confidence"))


@query
def diff_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.diff_nodes(*snapshots(spark, sf_dir))


@query
def diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.diff_edges(*snapshots(spark, sf_dir))


@query
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.diff_summary(*snapshots(spark, sf_dir))


@query
def validate_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = web(spark, sf_dir)
    n = g.nodes.union(g.nodes.filter("ord % 5 = 0").withColumn("ord", F.col("ord") + 1_000_000)).withColumn("label", F.when(F.col("ord") % 7 == 0, "").otherwise(F.col("label")))
    return B.violations(Graph(n, g.edges))


@query
def import_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web(spark, sf_dir).edges.groupBy("target").agg(F.count("*").alias("n"))


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = trade(spark, sf_dir).nodes.select("source_file").union(source_files(spark, sf_dir).select("path")).distinct()
    f = "source_file"
    return n.select(f, P.file_name(f).alias("name"), P.file_stem(f).alias("stem"), P.extension(f).alias("ext"), P.parent(f).alias("dir"), P.last_dir(f).alias("last"), P.top_dir(f).alias("top"), P.category(f).alias("category"))


@query
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.count_words("text", F.lit("txt")).alias("prose"), P.count_words("text").alias("code"))


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.content_hash("text", F.col("source")).alias("hash"))


@query
def corpus_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(P.count_words("text", F.lit("txt"))).alias("words"))
    return n.select("source", "words", P.corpus_verdict(F.col("words")).alias("verdict"), P.graph_verdict(F.col("words")).alias("size"))


@query
def line_rules_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.line_rules(source_files(spark, sf_dir))


@query
def rationale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rationale_lines(source_files(spark, sf_dir))


@query
def brace_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.brace_balance(source_files(spark, sf_dir))


@query
def cache_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = source_files(spark, sf_dir)
    then = now.filter(F.length("path") % 3 > 0).withColumn("content", F.when(F.length("path") % 2 == 0, F.concat("content", F.lit("\n# more"))).otherwise(F.col("content")))
    return X.changed(now, X.hashes(then)).select("path", "changed")


def classified(spark: SparkSession, sf_dir: str, ignored: list[str] = ()) -> DataFrame:
    """Paths made of parts: folders, names and extensions of many kinds."""
    p = table(spark, sf_dir, "part")
    kinds = ["py", "rs", "TS", "md", "png", "toml", "key", "exe", ""]
    dirs = ["src", "node_modules", "lib/target", "my_env", "docs", "a.egg-info", "token-svc"]
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    ext = pick(kinds, F.col("p_partkey"))
    rel = F.concat(pick(dirs, F.expr("p_partkey div 9")), F.when(F.col("p_partkey") % 11 == 0, "/.f").otherwise("/f"), "p_partkey", F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    return S.classify(p.select(rel.alias("path"), rel.alias("rel")), ignored)


@query
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("path", "extension", "file_type", "skipped")


@query
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stats(classify_files(spark, sf_dir))


@query
def ast_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.graph_of(cut(X.facts(source_files(spark, sf_dir))))
    return g.nodes.groupBy("node_type").agg(F.count("*").alias("n")).union(g.edges.groupBy("relation").agg(F.count("*")))


@query
def hyperedge_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of files and folders in their order."""
    return _groups(H.detect(sessions(spark, sf_dir), chains=False), "ord")


@query
def chain_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users did, in order, as if each were a chain."""
    g = sessions(spark, sf_dir)
    chains = g.nodes.groupBy(F.col("source_file").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("nodes"))
    return H.chain_cohesion(chains, g)


@query
def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.analyze(trade(spark, sf_dir)).rows()


@query
def build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in order and the edges of two overlapping extractions; communities, which SQL can't find, are in ``cluster``."""
    whole = sessions(spark, sf_dir)
    part = Graph(whole.nodes.filter("label <> 'click'").withColumn("label", F.upper("label")), whole.edges.filter("source like '%click'").withColumn("confidence", F.lit("INFERRED")))
    g = C.build_graph(part, whole)
    nodes = g.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("label").alias("b"), "ord")
    return nodes.union(g.edges.select(F.lit("edge"), F.concat("source", F.lit(">"), "target"), "confidence", "ord"))


@query
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = web(spark, sf_dir)
    return B.error_texts(Graph(g.nodes, g.edges.withColumn("confidence", F.when(F.col("ord") % 3 == 0, "LIKELY").otherwise(F.col("confidence"))))).select("kind", "id", "message")


@query
def sensitive_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).filter("reason is not null").select("path", "reason")


@query
def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir, [P.glob_pattern("*/f*7.py"), P.glob_pattern("docs/*")]).select("path", "skipped")


@query
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache after files of one size were added again and others removed."""
    files = source_files(spark, sf_dir)
    c = K.entries(files)
    c = K.remove(K.add(c, K.entries(files.filter("length(path) % 2 = 0").withColumn("content", F.lower("content")))), files.filter("length(path) % 3 = 0"))
    return K.stats(c)


@query
def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.entries(source_files(spark, sf_dir)).select("path", "hash", "size", "source_file")


@query
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).edges.groupBy("confidence", "confidence_score").agg(F.count("*").alias("n"))


@query
def extract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of one generated file of each of six languages for each type of part."""
    p = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_partkey").alias("k"))
    of = lambda language: [F.lit(x) if x != "@" else F.col("k").cast("string") for x in re.split("(@)", SOURCES[language]) if x]
    made = F.array(*(F.struct(F.concat(F.lit(f"f_{x}_"), "k", F.lit(f".{x}")).alias("path"), F.concat(*of(x)).alias("content")) for x in SOURCES))
    g = X.graph_of(cut(X.facts(p.select(F.explode(made).alias("x")).select("x.*"))))
    nodes = g.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("node_type").alias("b"), F.col("source_location").alias("c"))
    return nodes.union(g.edges.select(F.lit("edge"), "source", "target", F.concat_ws(" ", "relation", "confidence")))


@query
def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster(sessions(spark, sf_dir)).nodes.select("id", "community")


@query
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = with_groups(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(report_lines(g, bridges=False))), "line long, text string")


def queries() -> dict[str, Query]:
    return dict(QUERIES)
