"""Source trees, extraction, documents, incremental builds and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from skein.__main__ import main
from skein.functions import paths as P
from skein.operators import extract as X
from skein.plans.session import cut
from skein.sources import cache as K
from skein.sources import documents as D
from skein.sources import files as S
from skein.streaming import incremental as I

PROGRAM = {
    "py": "import os\nfrom shop.mail import send\n\nclass Order:\n    def total(self):\n        return add(1)\n\ndef add(x):\n    # NOTE: keeps tax out of it\n    return x\n",
    "rs": "struct Order { x: u32 }\nimpl Order {\n    fn total(&self) -> u32 { add(1) }\n}\nfn add(x: u32) -> u32 { x }\n",
    "go": 'package a\n\nimport (\n\t"fmt"\n)\n\ntype Order struct {}\n\nfunc (o *Order) total() int { return add(1) }\n\nfunc add(x int) int { return x }\n',
    "java": "import a.b.C;\npublic class Order {\n    public int total() { return add(1); }\n    private int add(int x) { return x; }\n}\n",
    "js": "import x from './mail';\nclass Order {\n  total() { return add(1); }\n}\nfunction add(x) { return x; }\n",
    "ts": "import { x } from './mail';\nclass Order {\n  total(): number { return add(1); }\n}\nfunction add(x: number): number { return x; }\n",
    "rb": "require 'mail'\nclass Order\n  def total\n    add(1)\n  end\nend\ndef add(x)\n  x\nend\n",
    "scala": "import a.b\nclass Order {\n  def total(): Int = add(1)\n  def add(x: Int): Int = x\n}\n",
    "php": "<?php\nuse App\\Mail;\nclass Order {\n  function total() { return add(1); }\n}\nfunction add($x) { return $x; }\n",
    "lua": "local m = require('mail')\nOrder = {}\nfunction Order:total()\n  return add(1)\nend\nfunction add(x)\n  return x\nend\n",
    "kt": "import a.Mail\nclass Order {\n  fun total(): Int { return add(1) }\n}\nfun add(x: Int): Int { return x }\n",
    "swift": "import Foundation\nclass Order {\n  func total() -> Int { return add(x: 1) }\n}\nfunc add(x: Int) -> Int { return x }\n",
    "c": '#include "mail.h"\nstruct Order { int x; };\nint add(int x) {\n  return x;\n}\nint total(void) {\n  return add(1);\n}\n',
    "cpp": '#include "mail.h"\nclass Order {};\nint add(int x) {\n  return x;\n}\nint total() {\n  return add(1);\n}\n',
    "zig": "const Order = struct { x: u32 };\nfn add(x: u32) u32 { return x; }\nfn total() u32 { return add(1); }\n",
    "ex": "defmodule Order do\n  import Mail\n  def total do\n    add(1)\n  end\n  def add(x), do: x\nend\n",
    "sh": "total() {\n  add 1\n}\nfunction add() {\n  echo $1\n}\n",
}


@pytest.mark.parametrize("ext", PROGRAM)
def test_languages(ext):
    rows = X.extract_file(f"src/shop.{ext}", PROGRAM[ext])
    nodes = {r["label"] for r in rows if r["what"] == "node"}
    assert {"total", "add"} <= nodes
    assert "Order" in nodes or ext == "sh"
    calls = {(r["source"], r["target"]) for r in rows if r.get("relation") == "calls"}
    assert ext == "sh" or ("shop:total", "shop:add") in calls
    assert ext in ("rs", "zig", "sh") or any(r.get("relation", "").startswith("imports") for r in rows)


def test_python_facts():
    text = 'class Shop:\n    """Sells more than twenty bytes of things."""\n    def go(self):\n        helper()\n        helper()\n\n# WHY: it must be so\n'
    rows = X.extract_file("a/shop.py", text)
    kinds = {r["node_type"] for r in rows if r["what"] == "node"}
    assert kinds == {"class", "function", "docstring", "rationale"}
    assert [r["confidence"] for r in rows if r.get("relation") == "calls"] == ["INFERRED", "EXTRACTED"]
    assert {r["target"] for r in rows if r.get("relation") == "rationale_for"} == {"shop:Shop", "shop"}
    assert [r["label"] for r in X.extract_file("b.py", "def broken(:\nclass World:\n")] == ["broken", "World"]
    assert [r["label"] for r in X.extract_file("b.unknown", "def hello():\n")] == ["hello"]


def test_text_functions(spark):
    rows = [("a/b.c.py", "x_1 two, three"), (".bashrc", ""), ("top", None), ("/x/y.md", "---\nt: 1\n---\nbody")]
    df = spark.createDataFrame(rows, "p string, t string")
    got = {r.p: r for r in df.select("p", P.file_stem("p").alias("stem"), P.extension("p").alias("ext"), P.top_dir("p").alias("top"), P.parent("p").alias("dir"), P.count_words("t", P.extension("p")).alias("n"), P.body("t", P.extension("p")).alias("body")).collect()}
    assert (got["a/b.c.py"].stem, got["a/b.c.py"].ext, got["a/b.c.py"].top, got["a/b.c.py"].dir, got["a/b.c.py"].n) == ("b.c", "py", "a", "a", 3)
    assert (got[".bashrc"].stem, got[".bashrc"].ext, got["top"].top) == (".bashrc", "", "top")
    assert got["/x/y.md"].top == "/" and got["/x/y.md"].body == "---\nbody"
    assert P.glob_pattern("a*.?s/") == r"^a.*\..s$"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    files = {"src/shop.py": PROGRAM["py"], "src/_private.py": "def hidden():\n    pass\n", "src/.dot.py": "x", "node_modules/a.js": "x", "docs/readme.md": "# hi", "pic.png": "x", "conf/my_secret.py": "x", "old/gone.py": "x", "Makefile": "x", ".skeinignore": "# no\ngone.*\n"}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "src/bad.py").write_bytes(b"\xff\xfe\x00")
    return root


def test_detect(spark, tree):
    found = {r.rel: r for r in S.detect(spark, str(tree)).collect()}
    assert {k for k, r in found.items() if r.skipped is None} == {"src/shop.py", "src/_private.py", "src/bad.py", "docs/readme.md", "pic.png"}
    assert (found["src/.dot.py"].skipped, found["conf/my_secret.py"].skipped, found["old/gone.py"].skipped, found["Makefile"].skipped) == ("hidden", "sensitive", "ignored", "no extension")
    df = S.detect(spark, str(tree))
    assert tuple(S.stats(df).first()) == (5, 3, 1, 1)
    texts = {r.path.rpartition("/")[2]: r.content for r in S.read(df.filter("skipped is null")).collect()}
    assert texts["bad.py"] is None and texts["shop.py"] == PROGRAM["py"]
    assert "only 3 code files" in S.warnings(df, 10)


def test_body(spark):
    files = spark.createDataFrame([("a.rs", PROGRAM["rs"]), ("a.py", PROGRAM["py"])], "path string, content string")
    got = {}
    for r in X.bodies(files, "add").orderBy("path", "line").collect():
        got.setdefault(r.path, []).append(r.s)
    assert got["a.rs"] == ["fn add(x: u32) -> u32 { x }"]
    assert got["a.py"][0] == "def add(x):" and got["a.py"][2] == "    return x"


def test_build_and_update(spark, tree, tmp_path, capsys):
    out = str(tmp_path / "out")
    g = I.build(spark, str(tree), out)
    names = {r.label for r in g.nodes.collect()}
    assert {"Order", "total", "add", "hidden"} <= names
    assert all(r.community is not None for r in g.nodes.collect())
    doc = json.loads((tmp_path / "out/graph.json").read_text())
    assert doc["metadata"]["total_nodes"] == len(doc["nodes"]) == g.nodes.count()
    assert "# Graph report" in (tmp_path / "out/REPORT.md").read_text()
    back = D.from_json(spark, f"{out}/graph.json")
    assert back.edges.count() == g.edges.count() and back.hyperedges.count() == g.hyperedges.count()
    (tree / "src/shop.py").write_text("class Basket:\n    def fill(self):\n        pass\n")
    again = I.build(spark, str(tree), out)
    names = {r.label for r in again.nodes.collect()}
    assert "Basket" in names and "hidden" in names and "Order" not in names
    assert D.export_stats(again, f"{out}/stats.json")["total_nodes"] == again.nodes.count()
    main(["query", f"{out}/graph.json", "what is order"])
    main(["explain", f"{out}/graph.json", "Basket"])
    main(["path", f"{out}/graph.json", "a", "b"])
    said = capsys.readouterr().out
    assert "NODE: Basket" in said and "No path between" in said
    assert I.build(spark, str(tree / "docs"), str(tmp_path / "none")) is None and not (tmp_path / "none").exists()


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.py").write_text("def first():\n    pass\n")
    run = lambda: I.stream(I.file_stream(spark, str(src)), str(tmp_path / "g"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    (src / "b.py").write_text("def second():\n    first()\n")
    run()
    g = D.from_parquet(spark, str(tmp_path / "g/v1"))
    assert {"first", "second"} <= {r.label for r in g.nodes.collect()}


def test_cache(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    new = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "w")], "path string, content string")
    h = X.hashes(old)
    assert {r.path: r.changed for r in X.changed(new, h).collect()} == {"a": False, "b": True, "c": True}
    assert all(len(r.hash) == 64 for r in h.collect())
    assert X.upsert(h, X.hashes(new)).count() == 3


def kept(path, text):
    rows = X.extract_file(path, text)
    return {r["id"] for r in rows if r["what"] == "node"}, {(r["source"], r["relation"], r["target"]) for r in rows if r["what"] == "edge"}


def test_comments_strings_and_places():
    nodes, edges = kept("a.rs", "// fn fake()\nfn new<'a>(x: &'a str) -> u8 { let c = 'x'; say(\"call(x)\"); 1 }\nfn deep() { fn inner() { low(); } high(); }\nlet s = r#\"fn no() \"#;\n")
    assert not {"a:fake", "a:no", "a:call"} & nodes and {"a:new", "a:deep", "a:inner"} <= nodes
    assert {("a:new", "calls", "a:say"), ("a:inner", "calls", "a:low"), ("a:deep", "calls", "a:high")} == {e for e in edges if e[1] == "calls"}
    nodes, edges = kept("b.js", 'function aa(){bb()}function bb(){cc(1)}var s="function str(){}";class Qq{ mm(){ if (x) { dd() } } }')
    assert {"b:aa", "b:bb", "b:Qq", "b:mm"} <= nodes and not {"b:str", "b:if"} & nodes
    assert ("b:mm", "calls", "b:dd") in edges and ("b:aa", "calls", "b:bb") in edges
    nodes, edges = kept("c.go", 'import (\n  "fmt"\n)\nfunc Run() { fmt.Print("x(y)") }\n')
    assert nodes == {"c:Run", "c:Print"} and ("c", "imports", "fmt") in edges
    nodes, edges = kept("d.rb", "def match(x)\n  foo(x)\nend\nbar(1) # baz(2)\n")
    assert ("d:match", "calls", "d:foo") in edges and ("d:global", "calls", "d:bar") in edges and "d:baz" not in nodes
    _, edges = kept("e.py", "from . import x\nfrom a.b import c\nfrom q import *\n")
    assert {t for _, _, t in edges} == {"x", "a_b", "c", "q"}
    assert [X.module_id(m) for m in ("./util", "../lib/z", "../../a.b", "..x")] == ["util", "lib_z", "a_b", "x"]


def test_long_reasons_are_cut_alike(spark):
    text = "# NOTE: " + "ü" * 150 + "\n"
    column = X.rationale_lines(spark.createDataFrame([("a.py", text)], "path string, content string")).first()["text"]
    (label,) = [r["label"] for r in X.extract_file("a.py", text) if r["what"] == "node"]
    assert column == label == "ü" * 98 + "..."


def test_deleted_files_go(spark, tmp_path):
    both = spark.createDataFrame([("a.py", "def aa():\n  pass\n"), ("b.py", "def bb():\n  pass\n")], "path string, content string")
    I.update(spark, both, str(tmp_path), chains=False, whole=True)
    again = I.update(spark, both.filter("path = 'b.py'"), str(tmp_path), chains=False, whole=True)
    assert [r.id for r in again.nodes.collect()] == ["b:bb"]
    with pytest.raises(Exception, match="can't be seen"):
        S.read(spark.createDataFrame([("/none/x.py",)], "path string")).collect()


def test_file_cache(spark, tmp_path):
    folder = str(tmp_path / "files")
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    assert K.load(spark, folder).count() == 0
    K.save(K.entries(files), folder)
    c = K.add(K.load(spark, folder), K.entries(spark.createDataFrame([("b", "z"), ("c", "w")], "path string, content string")))
    K.save(K.remove(c, files.filter("path = 'a'")), folder)
    now = K.load(spark, folder)
    assert sorted(r.path for r in now.collect()) == ["b", "c"] and K.stats(now).first().total_entries == 2
    assert K.clear(spark, folder) == 2 and K.load(spark, folder).count() == 0


def test_extraction_cache(spark, tmp_path):
    folder = str(tmp_path / "kept")
    files = spark.createDataFrame([("a.py", "def aa():\n  bb()\n"), ("b.py", "def cc():\n  pass\n"), ("c.py", "")], "path string, content string")
    none, missing = K.load_extractions(files, folder)
    assert none.nodes.count() == 0 and missing.count() == 3
    g = X.graph_of(X.facts(files))
    assert K.save_extractions(g, files, folder) == 2
    assert K.save_extractions(g, files, folder) == 2  # again: the latest counts, nothing comes twice
    back, missing = K.load_extractions(files, folder)
    assert [r.path for r in missing.collect()] == ["c.py"]
    assert sorted(r.id for r in back.nodes.collect()) == ["a:aa", "a:bb", "b:cc"] and back.edges.count() == g.edges.count() and back.hyperedges.count() == 0
    changed = spark.createDataFrame([("a.py", "def aa():\n  pass\n")], "path string, content string")
    assert K.load_extractions(changed, folder)[1].count() == 1
    assert K.clear(spark, folder) == 6


def test_cut_frees_shuffles(spark):
    """Shuffle files of a checkpoint's plan go without waiting for garbage collection; the rows stay."""
    files = lambda: {n for n in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    before = files()
    kept = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert sorted(r["count"] for r in kept.collect()) == [142] * 1 + [143] * 6
