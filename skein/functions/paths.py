"""Column functions over paths, source lines and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
CATEGORIES = {
    "code": "c cpp cs go h hpp java js kt lua php py rb rs scala swift ts zig".split(),
    "doc": "markdown md rst txt".split(),
    "paper": ["pdf"],
    "image": "gif jpeg jpg png svg webp".split(),
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    """Lower-case extension; '' for names without one and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(_c(path), r"[^/]\.([^./]*)$", 1))


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def parent(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def last_dir(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+)/[^/]*$", 1)


def top_dir(path: Column | str) -> Column:
    return F.when(F.startswith(_c(path), F.lit("/")), "/").otherwise(F.split_part(_c(path), F.lit("/"), F.lit(1)))


def category(path: Column | str) -> Column:
    ext, out = extension(path), None
    for name, extensions in CATEGORIES.items():
        hit = ext.isin(extensions)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def import_id(module: Column | str) -> Column:
    """Node id of an imported module: leading dots gone, separators to '_', lower case."""
    return F.lower(F.translate(F.regexp_replace(F.trim(_c(module)), r"^\.+", ""), "\\/.", "___"))


def count_words(text: Column | str, ext: Column | None = None) -> Column:
    """Words between blanks in prose, runs of word characters in code."""
    prose = F.size(F.filter(F.split(_c(text), r"\s+"), lambda w: w != ""))
    code = F.regexp_count(_c(text), F.lit(WORD))
    if ext is None:
        return code.cast("long")
    return F.when(ext.isin("md", "markdown", "txt", "rst"), prose).otherwise(code).cast("long")


def body(text: Column | str, ext: Column) -> Column:
    """Markdown from the closing mark of its front matter on; other text as it is."""
    t = _c(text)
    at = F.locate("\n---", F.substring(t, 4, 2_000_000_000))
    return F.when(ext.isin("md") & F.startswith(t, F.lit("---")) & (at > 0), F.substr(t, at + F.lit(4))).otherwise(t)


def content_hash(text: Column | str, path: Column | str) -> Column:
    """SHA-256 of a file's text and path; of Markdown the front matter doesn't count."""
    return F.sha2(F.concat(body(F.make_valid_utf8(_c(text)), extension(path)), F.lit("\n\0"), _c(path)), 256)


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def rounded(x: Column) -> Column:
    """Two places, halves away from zero."""
    return F.round(x * 100) / 100


def graph_verdict(n: Column) -> Column:
    return F.when(n < 10, "tiny").when(n < 100, "small").when(n < 1000, "medium").otherwise("large")


def corpus_verdict(words: Column) -> Column:
    return F.when(words < 50_000, "fits one context").when(words > 500_000, "very large").otherwise("ok")


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of an ignore pattern: * and ? match anything, / also a backslash."""
    said = {"*": ".*", "?": ".", "/": r"[/\\]", "[": "[", "]": "]"}
    return "^" + "".join(said.get(c) or re.escape(c) for c in glob.rstrip("/")) + "$"
