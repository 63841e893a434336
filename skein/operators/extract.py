"""Nodes and edges from source text."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import WORD, content_hash, extension, file_stem
from ..plans.graph import AMBIGUOUS, EDGE, EXTRACTED, INFERRED, NODE, Graph, conform
from ..plans.session import cut, numbered

KEYWORDS = ("fn ", "func ", "def ", "class ", "struct ", "interface ")
REASONS = ("FIXME", "HACK", "IMPORTANT", "NOTE", "RATIONALE", "TODO", "WHY")
LANGUAGES = {
    "bash": "bash sh", "c": "c h", "cpp": "cc cpp cxx hh hpp hxx", "elixir": "ex exs", "go": "go", "java": "java", "javascript": "cjs js jsx mjs", "kotlin": "kt kts", "lua": "lua",
    "php": "php", "python": "py pyi pyw", "ruby": "rb", "rust": "rs", "scala": "scala", "swift": "swift", "typescript": "ts tsx", "zig": "zig",
}
BY_EXTENSION = {e: name for name, es in LANGUAGES.items() for e in es.split()}
_I = r"([A-Za-z_]\w*)"
#: Definitions by language: pattern of the name, and the type of node.
_TYPES = rf"\b(?:class|struct|interface|trait|enum|object|protocol|record|union)\s+{_I}"
_BEGIN = r"(?:^|(?<=[{};]))[ \t]*"
_C_FUN = rf"{_BEGIN}(?:[\w:<>*&~\[\],]+[ \t]+)+[*&]*{_I}\s*\([^;{{}}]*\)[^;{{}}]*\{{"
DEFINITIONS = {
    "bash": [(rf"^\s*(?:function\s+)?{_I}\s*\(\)\s*\{{", "function")],
    "c": [(_C_FUN, "function"), (_TYPES, "class")],
    "cpp": [(_C_FUN, "function"), (_TYPES, "class")],
    "elixir": [(rf"\bdefp?\s+{_I}", "function"), (r"\bdefmodule\s+([\w.]+)", "class")],
    "go": [(rf"^\s*func\s+(?:\([^)]*\)\s*)?{_I}", "function"), (rf"^\s*type\s+{_I}\s+(?:struct|interface)", "class")],
    "java": [(_C_FUN, "function"), (_TYPES, "class")],
    "javascript": [(rf"\bfunction\s*\*?\s*{_I}", "function"), (rf"\b(?:const|let|var)\s+{_I}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", "function"), (rf"{_BEGIN}(?:(?:async|static|get|set)\s+)*{_I}\s*\([^)]*\)\s*\{{", "method"), (_TYPES, "class")],
    "kotlin": [(rf"\bfun\s+(?:<[^>]*>\s*)?{_I}", "function"), (_TYPES, "class")],
    "lua": [(r"\bfunction\s+(?:[\w]+[.:])*([A-Za-z_]\w*)", "function"), (rf"^\s*(?:local\s+)?{_I}\s*=\s*\{{", "class")],
    "php": [(rf"\bfunction\s+&?{_I}", "function"), (_TYPES, "class")],
    "ruby": [(r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", "function"), (rf"^\s*(?:class|module)\s+{_I}", "class")],
    "rust": [(rf"\bfn\s+{_I}", "function"), (_TYPES, "class")],
    "scala": [(rf"\bdef\s+{_I}", "function"), (_TYPES, "class")],
    "swift": [(rf"\bfunc\s+{_I}", "function"), (_TYPES, "class")],
    "typescript": [(rf"\bfunction\s*\*?\s*{_I}", "function"), (rf"\b(?:const|let|var)\s+{_I}[^=\n]*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)[^=\n]*=>", "function"), (rf"{_BEGIN}(?:(?:public|private|protected|static|async|readonly)\s+)*{_I}\s*\([^)]*\)[^;{{}}]*\{{", "method"), (_TYPES, "class")],
    "zig": [(rf"\bfn\s+{_I}", "function"), (rf"\bconst\s+{_I}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b", "class")],
}
_QUOTED = r"""['"]([^'"]+)['"]"""
IMPORTS = {
    "c": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "cpp": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\s]+)\"\s*$", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "kotlin": r"^\s*import\s+(?:[\w]+\.)*(\w+)",
    "javascript": rf"^\s*import\b[^'\"]*{_QUOTED}", "typescript": rf"^\s*import\b[^'\"]*{_QUOTED}", "php": r"^\s*use\s+(?:[\w]+\\)*(\w+)", "ruby": rf"^\s*require(?:_relative)?\s*\(?\s*{_QUOTED}", "scala": r"^\s*import\s+([\w.]+)", "swift": r"^\s*import\s+(\w+)", "lua": rf"\brequire\s*\(?\s*{_QUOTED}", "elixir": r"^\s*(?:import|alias|use)\s+([\w.]+)",
}
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_NO_CALL = frozenset("if for foreach while until unless switch catch return function fn func def sizeof elif elsif elseif match when and or not in new throw await typeof assert super import".split())
_DOUBLE, _SINGLE, _TICKS = r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'", r"`(?:\\.|[^`\\])*`"
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
#: Comments and strings by language, as two patterns; what comes first in a text wins.
_LINE_DOUBLE, _LINE_SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)'
HIDDEN = {
    "bash": (r"(?<!\S)#[^\n]*", rf"{_DOUBLE}|{_SINGLE}"), "ruby": (r"#(?!\{)[^\n]*|^=begin\b.*?^=end\b[^\n]*", rf"{_DOUBLE}|{_SINGLE}"), "elixir": (r"#(?!\{)[^\n]*", rf"{_TRIPLE}|{_DOUBLE}|{_SINGLE}"),
    "lua": (r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*", rf"{_LINE_DOUBLE}|{_LINE_SINGLE}|\[\[.*?\]\]"), "php": (rf"{_C_COMMENT}|#(?!\[)[^\n]*", rf"{_DOUBLE}|{_SINGLE}"),
    "rust": (_C_COMMENT, rf'r(#+)".*?"\1|{_DOUBLE}' + r"|'(?:\\.[^'\n]*|[^'\\\n])'"), "go": (_C_COMMENT, rf"{_LINE_DOUBLE}|{_LINE_SINGLE}|`[^`]*`"), "zig": (r"//[^\n]*", rf"{_LINE_DOUBLE}|{_LINE_SINGLE}|\\\\[^\n]*"),
    "javascript": (_C_COMMENT, rf"{_LINE_DOUBLE}|{_LINE_SINGLE}|{_TICKS}"), "typescript": (_C_COMMENT, rf"{_LINE_DOUBLE}|{_LINE_SINGLE}|{_TICKS}"), "swift": (_C_COMMENT, rf"{_TRIPLE}|{_LINE_DOUBLE}"),
    **{x: (_C_COMMENT, rf"{_TRIPLE}|{_LINE_DOUBLE}" + r"|'(?:\\.[^'\n]*|[^'\\\n])'") for x in ("java", "kotlin", "scala")}, **{x: (_C_COMMENT, rf"{_LINE_DOUBLE}|{_LINE_SINGLE}") for x in ("c", "cpp")},
}
#: Languages whose definitions end where their indentation does.
INDENTED = ("elixir", "lua", "ruby")


def line_rules(files: DataFrame) -> DataFrame:
    """``path, line, keyword, name``: definitions by keyword anywhere in a line, from plain text."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "s"))
    hits = lines.select("path", "line", "s", F.explode(F.array(*map(F.lit, KEYWORDS))).alias("k")).filter(F.contains("s", F.col("k")))
    name = F.regexp_extract(F.expr("substr(s, instr(s, k) + length(k))"), f"^({WORD})", 1)
    return hits.select("path", (F.col("line") + 1).cast("long").alias("line"), F.rtrim("k").alias("keyword"), name.alias("name")).filter("name <> ''")


def _bytes(column: str, n: int) -> Column:
    """The characters that the first ``n`` bytes hold whole."""
    raw = F.substring(F.encode(column, "UTF-8"), 1, n)
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\ufffd+$", "")


def rationale_lines(files: DataFrame) -> DataFrame:
    """``path, line, id, text, target``: comments that give reasons, in Python files; text of more than 200 bytes is cut."""
    lines = files.filter(extension("path") == "py").select("path", F.posexplode(F.split("content", "\n")).alias("line", "s"))
    s = F.trim("s")
    said = F.trim(F.regexp_extract(s, rf"^(?:#|//|/\*) (?:{'|'.join(REASONS)}):(.*)$", 1))
    hits = lines.filter(s.rlike(rf"^(?:#|//|/\*) (?:{'|'.join(REASONS)}):")).withColumns({"text": said, "line": (F.col("line") + 1).cast("long")}).filter(F.octet_length("text") > 5)
    stem = file_stem("path")
    return hits.select("path", "line", F.concat(stem, F.lit("_rationale_"), "line").alias("id"), F.when(F.octet_length("text") > 200, F.concat(_bytes("text", 197), F.lit("..."))).otherwise(F.col("text")).alias("text"), stem.alias("target"))


def brace_balance(files: DataFrame) -> DataFrame:
    """``path, line, balance``: brackets and braces open after each line."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "s"))
    delta = F.regexp_count("s", F.lit(r"[({]")) - F.regexp_count("s", F.lit(r"[)}]"))
    return lines.select("path", (F.col("line") + 1).cast("long").alias("line"), F.sum(delta).over(_by_line()).cast("long").alias("balance"))


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def bodies(files: DataFrame, name: str) -> DataFrame:
    """``path, line, s``: the lines of the first definition of ``name`` in each file, until its brackets close; a Python definition
    ends where its indentation does."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "s"))
    start = lines.filter(F.col("s").rlike(rf"\b(?:fn|def|func)\s+(?:\([^)]*\)\s*)?{re.escape(name)}\b")).groupBy("path").agg(F.min(F.struct("line", "s")).alias("b"))
    after = lines.join(start, "path").filter("line >= b.line")
    w = _by_line()
    opened = F.sum(F.regexp_count("s", F.lit(r"[({]"))).over(w)
    open_now = F.sum(F.regexp_count("s", F.lit(r"[({]")) - F.regexp_count("s", F.lit(r"[)}]"))).over(w)
    python = extension("path").isin("py", "pyi", "pyw")
    indent = F.length(F.regexp_extract("s", r"^(\s*)", 1))
    first = F.length(F.regexp_extract("b.s", r"^(\s*)", 1))
    over = F.when(python, (F.col("line") > F.col("b.line")) & (F.trim("s") != "") & (indent <= first)).otherwise((open_now <= 0) & (opened > 0))
    marked = after.withColumns({"over": over.cast("int"), "python": python})
    n_over = F.sum("over").over(w)
    return marked.withColumn("n", n_over).filter(F.when(F.col("python"), F.col("n") == 0).otherwise((F.col("n") == 0) | ((F.col("n") == 1) & (F.col("over") == 1)))).select("path", (F.col("line") + 1).alias("line"), "s")


def module_id(m: str) -> str:
    """Node id of an imported module; steps to this folder or those above are no part of it."""
    m = re.sub(r"^(?:\./)*(?:\.\./)*\.*", "", m.strip().strip("\"'"))
    return re.sub(r"[\\/.]", "_", m).lower()


class _File:
    """Facts of one file in order, without repeats of node ids."""

    def __init__(self, path: str) -> None:
        self.path, self.stem = path, PurePosixPath(path).stem
        self.rows: list[dict] = []
        self.known: set[str] = set()

    def node(self, name: str, line: int | None, kind: str, label: str | None = None, file_type: str = "code", plain: bool = False) -> str:
        i = name if plain else f"{self.stem}:{name}"
        if i not in self.known:
            self.known.add(i)
            self.rows.append({"what": "node", "id": i, "label": label or name, "source_file": self.path, "source_location": f"L{line or '?'}", "node_type": kind, "file_type": file_type, "file_stem": self.stem})
        return i

    def edge(self, source: str, target: str, relation: str, confidence: str = EXTRACTED) -> None:
        score = {EXTRACTED: 1.0, INFERRED: 0.75, AMBIGUOUS: 0.2}[confidence]
        self.rows.append({"what": "edge", "source": source, "target": target, "relation": relation, "confidence": confidence, "confidence_score": score, "source_file": self.path})

    def imports(self, module: str, relation: str = "imports") -> None:
        """An edge to a module; what has no name, and all of a module, gives none."""
        if (i := module_id(module)) and module != "*":
            self.edge(self.stem, i, relation)

    def call(self, caller: str, callee: str) -> None:
        i = f"{self.stem}:{callee}"
        sure = i in self.known
        source = self.node(caller, None, "function")
        self.node(callee, None, "function")
        self.edge(source, i, "calls", EXTRACTED if sure else INFERRED)


def _short(text: str) -> str:
    raw = text.encode()
    return text if len(raw) <= 200 else raw[:197].decode(errors="ignore") + "..."


def _python(out: _File, content: str) -> None:
    tree = ast.parse(content)
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    for n in ast.walk(tree):
        if isinstance(n, kinds) and len(n.name.encode()) >= 2:
            out.node(n.name, n.lineno, "class" if isinstance(n, ast.ClassDef) else "function")
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                out.imports(a.name)
        elif isinstance(n, ast.ImportFrom):
            for name in (n.module or "", *(a.name for a in n.names)):
                out.imports(name, "imports_from")

    def visit(n: ast.AST, owner: str) -> None:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, ast.Call):
                f = c.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name and len(name.encode()) >= 2:
                    out.call(owner, name)
            visit(c, c.name if isinstance(c, kinds) else owner)

    visit(tree, "global")
    for n in ast.walk(tree):
        if isinstance(n, kinds) and (doc := ast.get_docstring(n, clean=False)) and len(doc.strip().encode()) > 20:
            what = "class" if isinstance(n, ast.ClassDef) else "function"
            i = out.node(f"{out.stem}_docstring_{what}_{n.lineno}", n.lineno, "docstring", _short(doc.strip()), "rationale", True)
            out.edge(i, f"{out.stem}:{n.name}", "rationale_for")


def blanked(content: str, language: str, strings: bool = True) -> str:
    """The text with blanks for comments and, if asked, for strings; offsets and lines stay.  What looks like a comment in a string is none."""
    comment, string = HIDDEN[language]
    pattern = re.compile(rf"(?P<comment>{comment})|(?:{string})" if r"\1" not in string else rf"(?P<comment>{comment})|(?:{string.replace(chr(92) + '1', chr(92) + '2')})", re.S | re.M)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if strings or m["comment"] is not None else m[0], content)


def _end(code: str, at: int, language: str) -> int:
    """Where the definition named at an offset ends: with its braces, or where the indentation is no longer deeper than its own."""
    if language in INDENTED:
        begin = code.rfind("\n", 0, at) + 1
        own = len(code[begin:at]) - len(code[begin:at].lstrip())
        end = code.find("\n", at)
        while end >= 0:
            line_end = code.find("\n", end + 1)
            line = code[end + 1 : line_end if line_end >= 0 else len(code)]
            if line.strip() and len(line) - len(line.lstrip()) <= own:
                return end
            end = line_end
        return len(code)
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, at):
        if m[0] == ";":
            if depth == 0:
                return m.end()
        else:
            depth += 1 if m[0] == "{" else -1
            if depth <= 0:
                return m.end()
    return len(code)


def _by_patterns(out: _File, content: str, language: str) -> None:
    """Definitions by place, so a line may hold several; a call belongs to the innermost function around it."""
    code = blanked(content, language)
    found: dict[int, tuple[str, str]] = {}
    for pattern, kind in DEFINITIONS[language]:
        loose = pattern == _C_FUN or kind == "method"  # these also match statements such as ``if (...) {``
        for m in re.finditer(pattern, code, re.M):
            if len(m[1].encode()) >= 2 and not (loose and m[1] in _NO_CALL):
                found.setdefault(m.start(1), (m[1], kind))
    places, names = sorted(found), {name for name, _ in found.values()}
    breaks = [m.start() for m in re.finditer("\n", code)]
    for at in places:
        out.node(found[at][0], bisect_left(breaks, at) + 1, found[at][1])
    if language in IMPORTS:
        for m in re.finditer(IMPORTS[language], blanked(content, language, strings=False), re.M):
            out.imports(m[1])
    around: list[tuple[int, str]] = []  # functions that are open, the innermost last
    functions = iter([at for at in places if found[at][1] != "class"])
    ahead = next(functions, None)
    for m in _CALL.finditer(code):
        while ahead is not None and ahead < m.start():
            around.append((_end(code, ahead, language), found[ahead][0]))
            ahead = next(functions, None)
        while around and around[-1][0] <= m.start():
            around.pop()
        if (m[1] not in _NO_CALL or m[1] in names) and m.start() not in found and len(m[1].encode()) >= 2:
            out.call(around[-1][1] if around else "global", m[1])


def _plain(out: _File, content: str) -> None:
    for n, line in enumerate(content.split("\n"), 1):
        for k in KEYWORDS:
            if k in line and (m := re.match(r"\w+", line[line.index(k) + len(k) :])):
                out.node(m[0], n, "definition")


def extract_file(path: str, content: str) -> list[dict]:
    """Facts of one file: definitions, imports, calls, docstrings and reasons.  Text that doesn't parse falls back to line rules."""
    out = _File(path)
    language = BY_EXTENSION.get(PurePosixPath(path).suffix[1:].lower())
    try:
        if language == "python":
            _python(out, content)
        elif language:
            _by_patterns(out, content, language)
        else:
            _plain(out, content)
    except (SyntaxError, ValueError, RecursionError):
        _plain(out, content)
    if language == "python":
        for n, line in enumerate(content.split("\n"), 1):
            if (m := re.match(rf"(?:#|//|/\*) (?:{'|'.join(REASONS)}):(.*)", line.strip())) and len(m[1].strip().encode()) > 5:
                i = out.node(f"{out.stem}_rationale_{n}", n, "rationale", _short(m[1].strip()), "rationale", True)
                out.edge(i, out.stem, "rationale_for")
    return out.rows


_FACT = "what string, id string, label string, source_file string, source_location string, node_type string, file_type string, file_stem string, source string, target string, relation string, confidence string, confidence_score double, ord long"


def facts(files: DataFrame) -> DataFrame:
    """Nodes and edges of files ``path, content``, one row each, in order within a file (``ord``); files with null content have none."""
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.strip().split(" ") for c in _FACT.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                if content is not None:
                    yield pa.RecordBatch.from_pylist([r | {"ord": k} for k, r in enumerate(extract_file(path, content))], schema=schema)

    return files.select("path", "content").mapInArrow(run, _FACT)


def graph_of(found: DataFrame) -> Graph:
    """The graph of facts, in the order of paths and of places within a file."""
    placed = cut(numbered(found.withColumnRenamed("ord", "own"), "ord", "source_file", "own"))
    return Graph(conform(placed.filter("what = 'node'"), NODE), conform(placed.filter("what = 'edge'"), EDGE))


def hashes(files: DataFrame) -> DataFrame:
    """``path, hash``"""
    return files.select("path", content_hash("content", "path").alias("hash"))


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``path, hash, changed``: whether a file's hash is unknown to the cache (``path, hash``)."""
    old = cache.select("path", F.col("hash").alias("old"))
    return hashes(files).join(old, "path", "left").select("path", "hash", (F.col("old").isNull() | (F.col("old") != F.col("hash"))).alias("changed"))


def upsert(cache: DataFrame, now: DataFrame) -> DataFrame:
    return cache.select("path", "hash").join(now, "path", "left_anti").union(now.select("path", "hash"))
