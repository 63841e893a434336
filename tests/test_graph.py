"""Known answers on small graphs, and literal models of the iterative operators on random ones."""

import random
import tracemalloc
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import analyze as A
from skein.operators import build as B
from skein.operators import cluster as C
from skein.operators import hyper as H
from skein.operators import query as Q
from skein.operators.report import report_lines, stats_text, summary_text
from skein.plans.graph import EDGE, NODE, Graph, conform


def graph(spark, nodes, edges):
    """nodes: (id, file, community) or ids; edges: (source, target[, relation[, confidence]])."""
    n = [(x, x, f"{x}.py", None) if isinstance(x, str) else (x[0], x[0], x[1], x[2] if len(x) > 2 else None) for x in nodes]
    e = [(*x, *("calls", "EXTRACTED")[len(x) - 2 :]) for x in edges]
    nodes_ = spark.createDataFrame([(*x, i) for i, x in enumerate(n)], "id string, label string, source_file string, community int, ord long")
    edges_ = spark.createDataFrame([(*x, i) for i, x in enumerate(e)], "source string, target string, relation string, confidence string, ord long")
    return Graph(conform(nodes_, NODE), conform(edges_, EDGE))


def ids(rows):
    return [r[0] for r in rows.collect()]


def test_empty(spark):
    g = graph(spark, [], [])
    for df in (g.endpoints, g.incident, A.god_nodes(g), A.surprises(g), C.leiden(g), C.components(g), H.file_groups(g), H.call_chains(g), H.dir_groups(g), B.violations(g), A.betweenness(g), A.community_labels(g), Q.cohesion(g)):
        assert df.count() == 0
    assert A.questions(g).first().question_type == "no_signal"
    assert Q.query(g, "anything here") == "No matching nodes found."
    assert Q.shortest_path(g, "a", "b") is None
    assert A.graph_stats(g).first().avg_degree == 0


def test_paths(spark):
    g = graph(spark, "ABCD", [("A", "B"), ("B", "C"), ("C", "D")])
    assert Q.shortest_path(g, "A", "D") == list("ABCD")
    assert Q.shortest_path(g, "D", "A", 3) == list("DCBA")
    assert Q.shortest_path(g, "A", "D", 2) is None
    assert Q.shortest_path(g, "A", "nope") is None
    assert Q.shortest_path(g, "Z", "Z") == ["Z"]


def test_ring(spark):
    n = [f"n{i}" for i in range(100)]
    g = graph(spark, n, [(n[i], n[(i + k) % 100]) for i in range(100) for k in range(1, 6)])
    assert len(Q.shortest_path(g, "n0", "n50", 100)) == 11


def test_star_and_degrees(spark):
    g = graph(spark, ["Hub", *(f"Leaf{i}" for i in range(5))], [("Hub", f"Leaf{i}") for i in range(5)] + [("Hub", "Hub"), ("Leaf0", "gone")])
    assert A.god_nodes(g).first().id == "Hub"
    assert {r.id: r.degree for r in g.endpoints.collect()}["Hub"] == 7
    assert {r.id: r.degree for r in g.incident.collect()} == {"Hub": 6, "Leaf0": 2, "Leaf1": 1, "Leaf2": 1, "Leaf3": 1, "Leaf4": 1}


def test_three_relations_of_a_pair(spark):
    g = graph(spark, "ab", [("a", "b"), ("a", "b", "imports", "INFERRED"), ("a", "b", "uses", "AMBIGUOUS"), ("a", "b")])
    d = B.dedup(g)
    assert d.edges.count() == 3
    assert tuple(A.confidence_stats(d).first()) == (1, 1, 1)
    assert tuple(A.confidence_pct(d).first()) == (33, 33, 33, 3)


def test_merge_diff_validate(spark):
    old = graph(spark, "ab", [("a", "b")])
    new = graph(spark, "abc", [("a", "b"), ("b", "c"), ("b", "c")])
    m = B.merge_into(old, new)
    assert sorted(ids(m.nodes.select("id"))) == ["a", "b", "c"] and m.edges.count() == 3
    assert B.merge(old, new).edges.count() == 2
    assert B.diff_summary(old, new).first().summary == "1 new node, 2 new edges"
    assert B.diff_summary(new, old).first().summary == "1 node removed, 2 edges removed"
    assert B.diff_summary(old, old).first().summary == "no changes"
    bad = graph(spark, ["a", "a", ""], [("a", "x")])
    assert sorted((r.kind, r.id) for r in B.violations(bad).collect()) == [("DuplicateNodeId", "a"), ("EmptyLabel", ""), ("EmptyNodeId", ""), ("UnknownNodeReference", "x")]


@pytest.mark.parametrize("edges, groups", [([("a", "b"), ("b", "c"), ("c", "a")], 1), ([("a", "b"), ("c", "d")], 2), ([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")], 2)])
def test_communities(spark, edges, groups):
    g = graph(spark, sorted({x for e in edges for x in e}), edges)
    found = {r.id: r.community for r in C.leiden(g).collect()}
    assert len(set(found.values())) == groups and set(found.values()) == set(range(groups))


def random_graph(rng, n, m):
    names = [f"v{i:02}" for i in range(n)]
    edges = list(dict.fromkeys((rng.choice(names), rng.choice(names)) for _ in range(m)))
    return names, edges


def test_local_moves_by_component_are_those_of_the_whole(spark):
    rng = random.Random(3)
    for _ in range(4):
        names, edges = random_graph(rng, 24, 22)
        g = graph(spark, names, edges)
        at = {x: i for i, x in enumerate(names)}
        whole = C.local_move(len(names), [(at[a], at[b], 1.0) for a, b in edges], float(len(edges)))
        got = {r.id: r.community for r in C.leiden(g).collect()}
        by = {}
        for x, c in zip(names, whole):
            by.setdefault(c, set()).add(x)
        mine = {}
        for x, c in got.items():
            mine.setdefault(c, set()).add(x)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, mine.values()))
        sizes = [len(mine[c]) for c in sorted(mine)]
        assert sizes == sorted(sizes, reverse=True)


def test_split_keeps_all_nodes(spark):
    rng = random.Random(9)
    a, ea = random_graph(rng, 20, 50)
    g = graph(spark, [(x, "f", 4) for x in a] + [(f"w{i}", "f", 4) for i in range(20)] + [("z", "f", 1)], ea + [(f"w{i}", f"w{(i + 1) % 20}") for i in range(20)])
    got = {r.id: r.community for r in C.split_oversized(g, 25).collect()}
    assert len(got) == 41 and got["z"] == 1 and 4 in got.values() and max(got.values()) > 4
    assert not {got[x] for x in a} & {got[f"w{i}"] for i in range(20)}


def model_traverse(names, edges, start, depth):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    both = {}
    for i, (a, b) in enumerate(edges):
        both.setdefault(a, []).append((i, b))
        both.setdefault(b, []).append((i, a))
    seen, front, found = {start}, [start], []
    for _ in range(depth):
        nxt = []
        for a in front:
            for _, b in both.get(a, ()):
                if b not in seen:
                    nxt.append(b)
                    if b in adj.get(a, ()):
                        found.append((a, b))
        front = list(dict.fromkeys(nxt))
        seen |= set(front)
    return seen, sorted(found)


def test_bfs_dfs_and_paths_against_models(spark):
    rng = random.Random(5)
    for _ in range(3):
        names, edges = random_graph(rng, 20, 34)
        g = graph(spark, names, edges)
        starts = g.nodes.filter("id = 'v00'")
        nodes, links = Q.bfs(g, starts, 2)
        want, want_links = model_traverse(names, edges, "v00", 2)
        assert set(ids(nodes)) == want
        assert sorted((r.source, r.target) for r in links.collect()) == want_links
        walk = Q.dfs(g, starts, 3).collect()
        got = [r.a for r in walk if r.kind == "node"]
        near = {}
        for i, (a, b) in enumerate(edges):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        stack, seen, order = [("v00", 0)], set(), []
        while stack:
            a, d = stack.pop()
            if a not in seen and d <= 3:
                seen.add(a)
                order.append(a)
                stack += [(b, d + 1) for b in near.get(a, ()) if b not in seen]
        assert got == order and set(got) <= model_traverse(names, edges, "v00", 3)[0]
        # the path that a queue finds
        queue, up = deque(["v00"]), {"v00": None}
        while queue:
            a = queue.popleft()
            for b in near.get(a, ()):
                if b not in up:
                    up[b] = a
                    queue.append(b)
        for target in names[1:]:
            path = []
            x = target if target in up else None
            while x is not None:
                path.append(x)
                x = up[x]
            if target in ("v05", "v11"):
                assert Q.shortest_path(g, "v00", target, 30) == (path[::-1] or None)


def test_betweenness_of_a_path(spark):
    g = graph(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d")])
    got = {r.id: round(r.score, 6) for r in A.betweenness(g).collect()}
    assert got == {"a": 0, "d": 0, "b": round(2 / 3, 6), "c": round(2 / 3, 6)}


def test_groups(spark):
    nodes = [(f"a{i}", "src/auth/login.py") for i in range(3)] + [(f"b{i}", f"src/auth/x{i}.py") for i in range(3)] + [(f"r{i}", f"r{i}.py") for i in range(6)] + [(f"c{i}", "cfg/a.yaml") for i in range(3)]
    g = graph(spark, nodes, [("a0", "a1"), ("a1", "a2"), ("a2", "b0"), ("b0", "b1"), ("b1", "b2")])
    uses = Graph(g.nodes, g.edges.withColumn("relation", F.lit("uses")))
    got = {r.id: (sorted(r.nodes), round(r.confidence_score, 3)) for r in H.detect(uses).collect()}
    assert got["dir_auth"] == (["a0", "a1", "a2", "b0", "b1", "b2"], 1.0)
    assert got["file_login"][0] == ["a0", "a1", "a2"] and got["file_login"][1] == 0.667
    assert got["file_a"] == (["c0", "c1", "c2"], 0.5) and "config_yaml" not in got  # the same set as the file's
    assert not [i for i in got if i.startswith("dir_") and i != "dir_auth"]
    chains = [r.nodes for r in H.call_chains(g).collect()]
    assert ["a0", "a1", "a2"] in chains and len(chains) == 4 + 3 + 2 + 1
    with pytest.raises(ValueError):
        H.call_chains(g, max_rows=2)


def test_chains_within_components(spark):
    """Against a literal search, whether components are searched in a task or by joins; ``max_rows`` bounds each component."""
    rnd = random.Random(5)
    names = [f"p{p}n{i}" for p in range(6) for i in range(5)]
    links = [(a, b) for a in names for b in names if a != b and a[:2] == b[:2] and rnd.random() < 0.45]
    rnd.shuffle(links)
    g = graph(spark, names, links + links[:9])
    want = []

    def grow(path):
        if len(path) >= 3:
            want.append(path)
        for a, b in links:
            if a == path[-1] and b not in path:
                grow([*path, b])

    for x in names:
        grow([x])
    first = {}
    for n, path in enumerate(want):
        first.setdefault(frozenset(path), (n, path))
    for held in (10_000, 8):
        assert [r.nodes for r in H.call_chains(g, held=held).orderBy("key", "nodes").collect()] == want
        assert {r.id: r.nodes for r in H.chain_candidates(g, held=held).collect()} == {f"chain_{n}": path for n, path in first.values()}
    tied = Graph(g.nodes, g.edges.withColumn("ord", F.lit(1).cast("long")))
    assert {(r.id, *r.nodes) for r in H.chain_candidates(tied).collect()} == {(r.id, *r.nodes) for r in H.chain_candidates(tied, held=0).collect()}
    most = max(sum(p[0][:2] == f"p{k}" and len(p) == n for p in want) for k in range(6) for n in range(3, 6))
    assert H.call_chains(g, max_rows=max(most, len(links))).count() == len(want)
    small = graph(spark, [f"s{i}" for i in range(30)], [(f"s{i}", f"s{i + 1}") for i in range(29) if i % 3 < 2])
    assert H.call_chains(small, max_rows=2).count() == 10  # one a component, of twenty steps in all


def test_betweenness_holds_arrays():
    """A walk over a little of a large graph takes little beside the arrays that it is given."""
    n = 200_000
    near = np.zeros(2 * n, np.int32)
    near[0::2], near[1::2] = (np.arange(n) - 1) % n, (np.arange(n) + 1) % n
    near[[0, -1]] = 0, n - 1  # ends link to themselves here, so that it is a path
    near[2:8] = [0, 2, 1, 1, 3, 3]  # and breaks off after the third
    tracemalloc.start()
    total = A._walks(A._shortest, np.arange(0, 2 * n + 1, 2), near, [0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total[1] == 1 and peak < 3 * 8 * n


def test_candidates(spark):
    rows = [("x", ["a", "b"], 0.5), ("y", ["a", "b", "c"], 0.5), ("z", ["a", "b", "d"], 0.1), ("p", ["c", "a", "b"], 0.9)]
    c = spark.createDataFrame([(i, i, n, "r", "INFERRED", s, "f", 0, k) for k, (i, n, s) in enumerate(rows)], "id string, label string, nodes array<string>, relation string, confidence string, confidence_score double, source_file string, rank int, ord long")
    assert ids(H.process(c)) == ["y"]


def test_query_text(spark):
    g = graph(spark, [("OrderService", "svc/order.py", 1), ("Order", "model/order.py", 1), ("Mail", "svc/mail.py", 2)], [("OrderService", "Order"), ("OrderService", "Mail", "uses", "AMBIGUOUS")])
    text = Q.query(g, "how does the orderservice work")
    assert "OrderService --[uses: AMBIGUOUS]--> Mail" in text and "3 nodes found" in text
    assert "DFS depth=1" in Q.query(g, "orderservice", depth=1, use_dfs=True)
    assert Q.query(g, "order", community=9) == "No matching nodes found with filters."
    assert "truncated" in Q.query(g, "order", budget=10)
    assert Q.explain(g, "order").startswith("NODE: Order") and Q.explain(g, "none") == "Node 'none' not found"
    assert Q.terms("an ÖL the of to Of THE") == ["öl", "the", "the"]


def test_cross_community_surprises(spark):
    nodes = [(f"h{i}", "one.py", 0) for i in range(4)] + [("x", "one.py", 1), ("y", "one.py", 1), ("z", "one.py", 2)]
    g = graph(spark, nodes, [("h0", "h1"), ("h0", "h2"), ("h0", "h3"), ("h0", "x", "calls", "INFERRED"), ("h0", "y"), ("z", "h1", "calls", "AMBIGUOUS"), ("x", "y")])
    rows = A.surprises(g).collect()
    assert [(r.source, r.target) for r in rows] == [("z", "h1"), ("h0", "x")]
    assert rows[1].why.endswith("peripheral node unexpectedly reaches hub") and rows[1].score == 4


def test_report_lists_all(spark):
    """All ambiguous edges and thin communities; what isn't shown takes no place among the first."""
    hidden = [(f"__{i:02d}", "f.py", 1) for i in range(60)]
    nodes = hidden + [("shown", "f.py", 1), ("alone", "g.py", 2), ("other", "g.py", 3), ("third", "g.py", 3)]
    lines = report_lines(graph(spark, nodes, [(f"__{i:02d}", f"__{i + 1:02d}", "calls", "AMBIGUOUS") for i in range(25)]), bridges=False)
    at = lines.index("## Ambiguous edges")
    assert lines[at + 1 : at + 26] == [f"- `__{i:02d}` calls `__{i + 1:02d}`" for i in range(25)] and lines[at + 26] == ""
    assert [x.split(": ")[-1] for x in lines if "(61 nodes" in x] == ["`shown`"]
    assert "- isolated: `shown`" in lines and "- isolated: `alone`" in lines and not [x for x in lines if x.startswith("- isolated: `__")]
    thin = [x for x in lines if x.startswith("- thin: ")]
    assert len(thin) == 2 and "(community 2, 1 nodes)" in thin[0] and "(community 3, 2 nodes)" in thin[1]


def test_path_counts(spark):
    """Against a literal walk with a stack that carries whole paths."""
    rnd = random.Random(3)
    names = [f"n{i}" for i in range(9)]
    links = [tuple(rnd.choices(names, k=2)) for _ in range(16)]
    total = dict.fromkeys(names, 0.0)
    for s in names:
        stack, seen, paths = [s], set(), {s: [[s]]}
        while stack:
            v = stack.pop()
            if v in seen:
                continue
            seen.add(v)
            for a, b in links:
                w = b if a == v else a if b == v else None
                if w is not None and w not in seen:
                    paths.setdefault(w, []).extend([*p, w] for p in list(paths[v]))
                    stack.append(w)
        for w, p in paths.items():
            if w != s:
                total[w] += len(p)
    got = {r.id: r.score for r in A.betweenness(graph(spark, names, links), mode="path_count").collect()}
    assert got == pytest.approx({k: v * 2 / (8 * 7) for k, v in total.items()})
    with pytest.raises(ValueError):
        A.betweenness(graph(spark, names, links), mode="other")
    with pytest.raises(ValueError):
        A.betweenness(graph(spark, names, links), held=3)


def test_chain_cohesion_and_ranking(spark):
    g = graph(spark, [("a", "x.py"), ("b", "x.py"), ("c", "y.py"), ("d", "x.py")], [("a", "b"), ("c", "b"), ("c", "d")])
    chains = spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["a", "c", "d"]), ("3", ["a"]), ("4", []), ("5", ["a", "c"]), ("6", ["a", "b", "c", "d"]), ("7", ["b", "d", "c", "a"])], "c string, nodes array<string>")
    got = {r.c: r.score for r in H.chain_cohesion(chains, g).collect()}
    assert got == pytest.approx({"1": 1.0, "2": 0.6, "3": 0.5, "4": 0.5, "5": 0.0, "6": 1.0, "7": 1 / 3 + 0.1})
    nodes = [(f"a{i}", "one.py") for i in range(3)] + [(f"b{i}", "two.py") for i in range(3)]
    g = graph(spark, nodes, [("b0", "b1"), ("a0", "a1"), ("a1", "b0")])
    ranked = H.detect(g).orderBy("ord").collect()
    assert [r.ord for r in ranked] == list(range(len(ranked)))
    assert [r.confidence_score for r in ranked] == sorted((r.confidence_score for r in ranked), reverse=True)
    flows = [r for r in ranked if r.id.startswith("chain_")]
    assert flows and ranked[0].id == flows[0].id and flows[0].nodes == ["a0", "a1", "b0"]


def test_build_graph_and_analysis(spark):
    one = graph(spark, [("b", "x.py"), ("a", "x.py")], [("a", "b", "calls", "INFERRED")])
    two = graph(spark, [("c", "y.py"), ("a", "y.py")], [("a", "b"), ("b", "c")])
    g = C.build_graph(one, two)
    assert [(r.id, r.source_file) for r in g.nodes.orderBy("ord").collect()] == [("a", "x.py"), ("b", "x.py"), ("c", "y.py")]
    assert [(r.source, r.target, r.confidence, r.ord) for r in g.edges.orderBy("ord").collect()] == [("a", "b", "INFERRED", 0), ("b", "c", "EXTRACTED", 1)]
    assert all(r.community is not None for r in g.nodes.collect())
    rows = {(r.section, r.key): r.value for r in A.analyze(g).rows().collect()}
    assert rows["god", "b"] == "2" and rows["confidence", "inferred"] == "1"
    assert "1. b (degree: 2)" in stats_text(g) and "--- GOD NODES ---" in summary_text(g)
    broken = graph(spark, ["a"], [("a", "z", "calls", "SURE")])
    assert {r.message for r in B.error_texts(broken).collect()} == {"Edge 'a -> z' references unknown node: z", "Invalid confidence value: SURE (not EXTRACTED, INFERRED or AMBIGUOUS)"}
