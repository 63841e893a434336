"""Source trees: listing, ignore files, classification and reading."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import count_words, extension, file_name, glob_pattern

NOISE_DIRS = frozenset(".bzr .cargo .eggs .env .git .hg .mypy_cache .pytest_cache .ruff_cache .svn .tox .venv __pycache__ build dist env lib64 node_modules out site-packages target vendor venv".split())
NOISE_ENDS = (".egg-info", "_env", "_venv")
CODE = frozenset("c cc cjs cpp cs cxx ex exs go h hpp hxx java jl js json jsx kt kts lua m mjs mm php ps1 psm1 py pyi pyw rb rs scala swift toml ts tsx yaml yml zig".split())
MARKDOWN = frozenset("markdown md mdx txt".split())
#: Parts of paths that hold secrets; those of the second kind only at the end.
SECRET = "credential passwd password private_key secret token id_dsa id_ecdsa id_ed25519 id_rsa service.account".split()
SECRET_ENDS = "cert crt der env envrc htpasswd key netrc p12 p8 pem pfx pgpass".split()
SENSITIVE = "|".join([*(s.replace(".", r"\.") for s in SECRET), rf"\.(?:{'|'.join(SECRET_ENDS)})$"])
FILES = "path string, rel string, size_bytes long, modified long"


def ignore_patterns(root: str, name: str = ".skeinignore") -> list[str]:
    """Regular expressions from the ignore files of a folder and those above it, up to a repository's root."""
    out: list[str] = []
    for d in (p := Path(root).resolve(), *p.parents):
        if (d / name).is_file():
            lines = (d / name).read_text(errors="replace").splitlines()
            out += [glob_pattern(x.strip()) for x in lines if x.strip() and not x.strip().startswith("#")]
        if (d / ".git").exists():
            break
    return out


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``, also those that Spark's own readers hide.  Only names and sizes pass through the driver."""
    rows = []
    for d, dirs, names in os.walk(root, followlinks=False):
        dirs[:] = sorted(x for x in dirs if x not in NOISE_DIRS and not x.endswith(NOISE_ENDS))
        for n in sorted(names):
            p = os.path.join(d, n)
            if not os.path.islink(p):
                s = os.stat(p)
                rows.append((p, os.path.relpath(p, root), s.st_size, int(s.st_mtime)))
    return spark.createDataFrame(rows, FILES)


def sensitive_reason(path) -> Column:
    """Which part of a path looks like a secret, null if none does: the first in the order of the list."""
    hits = [F.when(F.col(path).rlike(s.replace(".", r"\.")), F.lit(f"has '{s}'")) for s in SECRET] + [F.when(F.col(path).rlike(rf"\.{s}$"), F.lit(f"ends in '.{s}'")) for s in SECRET_ENDS]
    return F.coalesce(*hits)


def classify(files: DataFrame, ignored: list[str] = ()) -> DataFrame:
    """``files`` (with ``path`` and ``rel``) plus ``extension, file_type, skipped, reason``: why a file is left out, null if it isn't, and what
    makes its path sensitive if that is why.

    File types are code, markdown and binary.  Left out are, in this order, hidden files, those in noise folders, ignored
    ones, those whose path looks like a secret, and those without an extension."""
    name, ext = file_name("rel"), extension("rel")
    dirs = F.slice(F.split("rel", "/"), 1, F.greatest(F.size(F.split("rel", "/")) - 1, F.lit(0)))
    noisy = F.exists(dirs, lambda d: d.isin(*NOISE_DIRS) | d.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in NOISE_ENDS) + ")$"))
    skip = F.when(F.startswith(name, F.lit(".")), "hidden").when(noisy, "noise")
    if ignored:
        pattern = "|".join(f"(?:{p})" for p in ignored)
        skip = skip.when(F.col("rel").rlike(pattern) | name.rlike(pattern), "ignored")
    skip = skip.when(F.col("path").rlike(SENSITIVE), "sensitive").when(ext == "", "no extension")
    kind = F.when(ext.isin(*CODE), "code").when(ext.isin(*MARKDOWN), "markdown").otherwise("binary")
    return files.withColumns({"extension": ext, "file_type": kind, "skipped": skip}).withColumn("reason", F.when(F.col("skipped") == "sensitive", sensitive_reason("path")))


def detect(spark: SparkSession, root: str) -> DataFrame:
    return classify(listing(spark, root), ignore_patterns(root))


def stats(files: DataFrame) -> DataFrame:
    """``total, code, markdown, binary`` of the files that aren't left out."""
    kept = files.filter("skipped is null")
    return kept.agg(F.count("*").alias("total"), *[F.count_if(F.col("file_type") == k).alias(k) for k in ("code", "markdown", "binary")])


def read(files: DataFrame) -> DataFrame:
    """``path, content``: text of files, null where it isn't UTF-8 or mayn't be read.  Executors read the files where they are; one that
    isn't there fails the job, since a cluster without a shared file system would otherwise give an empty graph."""

    def text(path: str) -> str | None:
        try:
            return Path(path).read_bytes().decode()
        except FileNotFoundError as e:
            raise FileNotFoundError(f"{path} was listed but can't be seen by an executor: it was removed, or the folder isn't shared") from e
        except (OSError, UnicodeDecodeError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.column(0).slice(i, 64)
                yield pa.RecordBatch.from_arrays([part, pa.array([text(p) for p in part.to_pylist()], pa.string())], names=["path", "content"])

    return files.select("path").mapInArrow(run, "path string, content string")


def words(files: DataFrame) -> DataFrame:
    """``words``: of ``path, content, size_bytes``, by kind of file; a fifth of the size where there is no text."""
    n = F.coalesce(count_words("content", extension("path")), F.floor(F.col("size_bytes") / 5))
    return files.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("words"))


def warnings(files: DataFrame, n_words: int) -> list[str]:
    """What is odd about a corpus."""
    r = stats(files).first()
    said = [(r.code < 5, f"only {r.code} code files"), (r.total > 200, f"{r.total} files: this may take a while"), (n_words < 50_000, f"{n_words} words fit one context"), (n_words > 500_000, f"{n_words} words are many")]
    return [text for true, text in said if true]
