"""The pipeline against the brute-force versions of its stages."""

import base64
import importlib
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm.bpe import VOCABULARY
from skein.plans.session import cut

from .test_search import SCHEMA, brute_groups, brute_lines, edited, prose


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    texts = ["\n".join(prose(rng, int(n)) for n in rng.integers(4, 25, int(m))) for m in rng.integers(1, 6, 50)]
    texts += ["\n".join(edited(rng, s, 0.08) for s in t.split("\n")) for t in texts[:20]]
    texts += texts[:6] + [f"{texts[7]}\n{prose(rng, 9)}", "привет мир это текст без обучения", "12 34 56", "", None, "word " * 20_000]
    item = "Anna walks 12 km to the market and buys 5 red apples for her mother every week."
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(900, prose(rng, 30) + " " + item), (901, item.replace("12", "77").replace("Anna", "Peter") + " " + prose(rng, 30)), (None, prose(rng, 40)), (2, texts[2]), (4, prose(rng, 12))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows


def test_stages(spark, made):
    d, rows = made
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    got = corpus_pipeline.language(spark, docs, d)
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert got.columns == columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    # lines: of repeated ids, a line falls in the row whose text has it
    got = corpus_pipeline.lines(spark, got, d)
    fallen = {r[:2] for r in brute_lines(want)}
    first = {}
    left = []
    for i, t in want:
        lines = t.split("\n")
        stay = [s for n, s in enumerate(lines) if (i, n) not in fallen or _kept(want, i, n, s)]
        if "\n".join(stay).strip():
            left.append((i, "\n".join(stay)))
    assert got.columns == columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, left))
    got = corpus_pipeline.near_duplicates(spark, got, d)
    roots, sets = brute_groups(left)
    kept = got.collect()
    assert got.columns == columns and len(kept) == len({r for r, s in zip(roots, sets) if s}) + sum(not s for s in sets)
    seen = {(r.doc_id, r.text) for r in kept}
    for r in set(roots):
        group = [left[i] for i in range(len(left)) if roots[i] == r]
        assert len(seen & set(group)) == 1
    last = corpus_pipeline.decontaminate(spark, got, d)
    gone = seen - {(r.doc_id, r.text) for r in last.collect()}
    assert {i for i, _ in gone} == {900, 901} and last.columns == columns
    tokens = {r.doc_id: r for r in corpus_pipeline.tokens(spark, last, d).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in seen - gone:
        if i not in (4,):
            assert tokens[i].token_ids == own.encode_ordinary(t) and tokens[i].exact
    whole = corpus_pipeline.run(spark, d)
    assert sorted(str(tuple(r)) for r in whole.collect()) == sorted(str(tuple(r)) for r in corpus_pipeline.tokens(spark, last, d).collect())


def _kept(rows, i, n, s):
    """Whether the line of this row stays although one at its place, in another row of the same id, falls."""
    if sum(x == i for x, _ in rows) == 1:
        return False
    own = s.strip(" \t\r")
    from .test_search import distance_one

    place = lambda p: (p[0] is None, p[0] or 0, p[1])
    near = lambda z: z == own or min(len(z), len(own)) >= 16 and distance_one(z, own)
    return not own or not any(place((j, m)) < place((i, n)) and near(z.strip(" \t\r")) for j, t in rows for m, z in enumerate(t.split("\n")))


def test_languages_are_written(spark, made):
    d, rows = made
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("lang", F.lit("xx"))
    by_id = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs.filter("doc_id is not null"), d).collect()}
    russian = next(i for i, t in rows if t and t.startswith("привет"))
    assert by_id.pop(russian) == "ru" and set(by_id.values()) == {"xx"}


def test_columns_of_any_name_stay(spark, made):
    d, _ = made
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 as h", "'a' as t", "2 as root", "3 as key", "4 as gone", "5 as keep_id", "6 as block", "7 as salt", "8 as `odd name`")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, d))
        assert docs.columns == columns
    assert {tuple(r) for r in docs.select(*columns[5:]).distinct().toLocalIterator()} == {(1, "a", 2, 3, 4, 5, 6, 7, 8)}
    assert corpus_pipeline.tokens(spark, docs, d).count() == docs.count() > 40


def test_empty_tables(spark, made):
    d, _ = made
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] and docs.count() == 0
    assert corpus_pipeline.tokens(spark, docs, d).count() == 0


def test_entry_works_without_these_parts(monkeypatch):
    """Only a missing part is passed over; a part that fails to import is not."""
    import __spark_entry__ as entry

    assert {"pipeline", "op8_near_duplicates"} <= set(entry.queries())
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("skein.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("skein.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named '{name}'", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    importlib.invalidate_caches()
