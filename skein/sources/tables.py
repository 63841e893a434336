"""Graphs and source files made from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import import_id
from ..plans.graph import AMBIGUOUS, EDGE, EXTRACTED, INFERRED, NODE, Graph, confidence_score, conform

T = 10**12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, kind: str, rank: int, key: str, label: str, file, community) -> DataFrame:
    return df.select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.col(label).alias("label"), file.alias("source_file"), F.lit("").alias("source_location"), community.cast("int").alias("community"), F.lit(kind).alias("node_type"), (F.lit(rank * T) + F.col(key)).alias("ord"))


def trade(spark: SparkSession, sf_dir: str, ships=None) -> Graph:
    """Regions, nations, suppliers, customers and parts; ``ships`` filters the lines that link parts and suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    none, c = F.lit(None), F.concat
    nodes = (
        _nodes(t("region"), "region", 0, "r_regionkey", "r_name", F.lit("geo/region.tbl"), none)
        .union(_nodes(t("nation"), "nation", 1, "n_nationkey", "n_name", F.lit("geo/nation.tbl"), F.col("n_nationkey")))
        .union(_nodes(t("supplier"), "supplier", 2, "s_suppkey", "s_name", c(F.lit("supply/n"), "s_nationkey", F.lit("/supplier.tbl")), F.col("s_nationkey")))
        .union(_nodes(t("customer"), "customer", 3, "c_custkey", "c_name", c(F.lit("sales/n"), "c_nationkey", F.lit("/"), "c_mktsegment", F.lit(".tbl")), F.col("c_nationkey")))
        .union(_nodes(t("part"), "part", 4, "p_partkey", "p_name", c(F.lit("catalog/"), "p_brand", F.lit("/"), "p_type", F.lit(".tbl")), none))
    )

    def link(df: DataFrame, a: str, ka: str, b: str, kb: str, relation: str, rank: int) -> DataFrame:
        return df.select(c(F.lit(f"{a}:"), ka).alias("source"), c(F.lit(f"{b}:"), kb).alias("target"), F.lit(relation).alias("relation"), F.lit(EXTRACTED).alias("confidence"), (F.lit(rank * 1000 * T) + F.col(ka)).alias("ord"))

    lines = t("lineitem")
    lines = lines if ships is None else lines.filter(ships)
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    calls = pairs.select(c(F.lit("part:"), "l_partkey").alias("source"), c(F.lit("supplier:"), "l_suppkey").alias("target"), F.lit("calls").alias("relation"), F.when(F.col("n") >= 3, EXTRACTED).when(F.col("n") == 2, INFERRED).otherwise(AMBIGUOUS).alias("confidence"), (F.lit(4000 * T) + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("ord"))
    edges = (
        link(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "contains", 1)
        .union(link(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "located_in", 2))
        .union(link(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "located_in", 3))
        .union(calls)
        .withColumn("confidence_score", confidence_score())
        .withColumn("source_file", F.lit(""))
    )
    return Graph(conform(nodes, NODE), conform(edges, EDGE))


def sessions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, target, relation, confidence, ord``: every step from one event of a user to the next, with repeats."""
    e = table(spark, sf_dir, "events")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat(F.lit("u"), "user_id", F.lit(":"), "event_type")
    steps = e.select(node.alias("source"), F.lead(node).over(by_user).alias("target"), F.lit("calls").alias("relation"), F.lit(EXTRACTED).alias("confidence"), F.col("event_id").alias("ord"))
    return steps.filter("target is not null").withColumns({"confidence_score": F.lit(1.0), "source_file": F.lit("")})


def sessions(spark: SparkSession, sf_dir: str) -> Graph:
    """What users do, by event type, and the distinct steps between; a user is a community, a log file and, by three, a folder."""
    e = table(spark, sf_dir, "events")
    nodes = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("ord"))
    nodes = nodes.select(F.concat(F.lit("u"), "user_id", F.lit(":"), "event_type").alias("id"), F.col("event_type").alias("label"), F.concat(F.lit("users/d"), F.expr("user_id div 3"), F.lit("/u"), "user_id", F.lit(".log")).alias("source_file"), F.lit("").alias("source_location"), F.col("user_id").cast("int").alias("community"), F.lit("event").alias("node_type"), "ord")
    edges = sessions_raw(spark, sf_dir).groupBy("source", "target", "relation", "confidence", "confidence_score", "source_file").agg(F.min("ord").alias("ord"))
    return Graph(conform(nodes, NODE), conform(edges, EDGE))


def shelves(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, each linked to the next of its brand and to the next of its type: one large component with long paths."""
    p = table(spark, sf_dir, "part")
    nodes = _nodes(p, "part", 0, "p_partkey", "p_name", F.concat(F.lit("shelf/"), "p_brand", F.lit("/"), "p_type", F.lit(".tbl")), F.regexp_extract("p_brand", "([0-9]+)$", 1))

    def chain(by: str, rank: int) -> DataFrame:
        after = F.lead("p_partkey").over(Window.partitionBy(by).orderBy("p_partkey"))
        e = p.select("p_partkey", after.alias("next")).filter("next is not null")
        return e.select(F.concat(F.lit("part:"), "p_partkey").alias("source"), F.concat(F.lit("part:"), "next").alias("target"), F.lit(by).alias("relation"), F.lit(EXTRACTED).alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit("").alias("source_file"), (F.lit(rank * T) + F.col("p_partkey")).alias("ord"))

    return Graph(conform(nodes, NODE), conform(chain("p_brand", 0).union(chain("p_type", 1)), EDGE))


def histories(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders, each of which leads to the next of its customer: paths of some dozens of nodes."""
    o = table(spark, sf_dir, "orders")
    nodes = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.concat(F.lit("customers/c"), "o_custkey", F.lit(".log")).alias("source_file"), F.lit("").alias("source_location"), F.col("o_custkey").cast("int").alias("community"), F.lit("order").alias("node_type"), F.col("o_orderkey").alias("ord"))
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    e = o.select("o_orderkey", after.alias("next")).filter("next is not null")
    edges = e.select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("o"), "next").alias("target"), F.lit("calls").alias("relation"), F.lit(EXTRACTED).alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit("").alias("source_file"), F.col("o_orderkey").alias("ord"))
    return Graph(conform(nodes, NODE), conform(edges, EDGE))


def web(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages and what they link to; link targets have no node."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    nodes = p.select(F.concat(F.lit("page:"), "page_id").alias("id"), F.col("url").alias("label"), host.alias("source_file"), F.lit("").alias("source_location"), F.lit("page").alias("node_type"), F.col("page_id").alias("ord"))
    links = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("n", "href"))
    edges = links.select(F.concat(F.lit("page:"), "page_id").alias("source"), import_id("href").alias("target"), F.lit("imports").alias("relation"), F.lit(EXTRACTED).alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit("").alias("source_file"), (F.col("page_id") * 100_000 + F.col("n")).alias("ord"))
    return Graph(conform(nodes, NODE), conform(edges, EDGE))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: one Python-like file for each brand and type of part."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.translate("p_name", " -", "__"), F.lit("_"), "p_partkey")
    text = F.concat(F.lit("# NOTE: part "), "p_partkey", F.lit("\nclass Part"), "p_partkey", F.lit(":\ndef "), name, F.lit("():\n  fn size"), "p_size", F.lit("() {\n    return ("), "p_size", F.lit(")\n  }\n"))
    made = p.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("x")))).alias("xs"))
    return made.select(F.concat(F.lit("catalog/"), "p_brand", F.lit("/"), "p_type", F.lit(".py")).alias("path"), F.array_join(F.transform("xs", lambda x: x.x), "").alias("content"))
