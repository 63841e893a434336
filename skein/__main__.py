"""python -m skein build PATH --output DIR | query GRAPH TEXT | path GRAPH A B | explain GRAPH X | body ROOT NAME"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import extract, query
from .sources import documents, files
from .streaming.incremental import build


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="skein", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="a graph from source files; again, only what changed is read")
    b.add_argument("path")
    b.add_argument("--output", default="skein-out")
    q = sub.add_parser("query")
    q.add_argument("graph")
    q.add_argument("text")
    q.add_argument("--dfs", action="store_true")
    q.add_argument("--depth", type=int, default=3)
    q.add_argument("--budget", type=int, default=2000)
    q.add_argument("--node-type")
    q.add_argument("--community", type=int)
    q.add_argument("--source")
    q.add_argument("--hyperedge")
    r = sub.add_parser("path")
    r.add_argument("graph")
    r.add_argument("a")
    r.add_argument("b")
    r.add_argument("--max-hops", type=int, default=8)
    e = sub.add_parser("explain")
    e.add_argument("graph")
    e.add_argument("name")
    o = sub.add_parser("body")
    o.add_argument("root")
    o.add_argument("name")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("skein").getOrCreate()
    if a.command == "build":
        g = build(spark, a.path, a.output)
        print("no code files" if g is None else f"{g.nodes.count()} nodes, {g.edges.count()} edges, {g.hyperedges.count()} hyperedges in {a.output}")
    elif a.command == "body":
        found = files.read(files.detect(spark, a.root).filter("skipped is null and file_type = 'code'"))
        for row in extract.bodies(found, a.name.rpartition(":")[2]).orderBy("path", "line").collect():
            print(f"    | {row.s}")
    else:
        g = documents.from_json(spark, a.graph)
        if a.command == "query":
            filters = {"node_type": a.node_type, "community": a.community, "source": a.source, "hyperedge": a.hyperedge}
            print(query.query(g, a.text, a.depth, a.budget, a.dfs, **{k: v for k, v in filters.items() if v is not None}))
        elif a.command == "path":
            found = query.shortest_path(g, a.a, a.b, a.max_hops)
            print(" -> ".join(found) if found else f"No path between '{a.a}' and '{a.b}'")
        else:
            print(query.explain(g, a.name))


if __name__ == "__main__":
    main()
