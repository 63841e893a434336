"""I-Match document fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, shuffle_partitions, text_slices

SUBSETS = 4
KEEP_BELOW = "b"  # a term is in subset s if digit s of its MD5 is below: 11 of 16


def distinct_terms(w: Words) -> np.ndarray:
    """Indices of one occurrence of each distinct word of each text, by text."""
    h, of = w.hash, w.of
    order = np.lexsort((h, of))
    if len(order):
        same = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
        order = order[np.concatenate(([True], ~same))]
    return order


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``term`` (hash) and ``df`` over all documents; each task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([_signed(h), pa.array(n, pa.int64())], names=["term", "df"])

        for _, texts in text_slices(batches, "text"):
            w = Words(texts)
            held.append(w.hash[distinct_terms(w)])
            if sum(map(len, held)) > 4_000_000:
                yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _prints(ids: list, per_doc: list[list[str]]) -> pa.RecordBatch:
    rows: dict[str, list] = {"doc_id": [], "subset": [], "n_terms": [], "fingerprint": []}
    digest: dict[str, str] = {}
    for i, terms in zip(ids, per_doc):
        digits = []
        for t in terms:
            d = digest.get(t)
            if d is None:
                d = digest[t] = md5(t.encode()).hexdigest()[:SUBSETS]
            digits.append(d)
        for s in range(SUBSETS + 1):
            kept = terms if s == 0 else [t for t, d in zip(terms, digits) if d[s - 1] < KEEP_BELOW]
            rows["doc_id"].append(i)
            rows["subset"].append(s)
            rows["n_terms"].append(len(kept))
            rows["fingerprint"].append(md5(" ".join(kept).encode()).hexdigest() if kept else None)
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("subset", pa.int32()), ("n_terms", pa.int64()), ("fingerprint", pa.string())]))


SCHEMA = "doc_id long, subset int, n_terms long, fingerprint string"


def imatch(docs: DataFrame, low: float = 0.15, high: float = 0.8, broadcast_terms: int = 4_000_000) -> DataFrame:
    """``doc_id, subset, n_terms, fingerprint``: five rows a document, subset 0 with the whole lexicon, 1 to 4 with random parts.

    The lexicon holds the terms with low <= idf <= high, where idf = ln(N / df) / ln(N) and N counts the documents with text.
    A fingerprint is the MD5 of the document's distinct lexicon terms in order; two documents match in a subset if theirs are
    equal.  It is null if no term remains (short, empty and null texts).  Repeated rows give repeated results and count
    separately in df; a null doc_id stays null; an empty table gives no rows; texts of any length count as a whole; other
    columns are ignored, whatever their names.

    The lexicon goes to the executors as sorted hashes if it has at most ``broadcast_terms``; else it is joined by a shuffle."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = rows.agg(F.count("text")).first()[0]
    log_n = F.log(F.lit(float(max(n, 2))))
    idf = (log_n - F.log(F.col("df").cast("double"))) / log_n
    lexicon = document_frequencies(rows.filter("text is not null")).filter((idf >= low) & (idf <= high)).select("term")
    some = lexicon.limit(broadcast_terms + 1).toArrow()
    if some.num_rows > broadcast_terms:
        return _by_join(rows, lexicon)
    known = spark.sparkContext.broadcast(np.sort(some.column("term").to_numpy().view(U)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = known.value
        for batch, texts in text_slices(batches, "text"):
            w = Words(texts)
            h, at = w.hash, distinct_terms(w)
            if len(lex):
                at = at[lex[np.minimum(np.searchsorted(lex, h[at]), len(lex) - 1)] == h[at]]
            else:
                at = at[:0]
            uniq, first, code = np.unique(h[at], return_index=True, return_inverse=True)
            names = w.strings(at[first])
            order = sorted(range(len(names)), key=names.__getitem__)
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            names = [names[i] for i in order]
            bounds = np.searchsorted(w.of[at], np.arange(len(texts) + 1))
            ranks = rank[code]
            per_doc = [[names[i] for i in np.sort(ranks[a:b]).tolist()] for a, b in zip(bounds[:-1], bounds[1:])]
            yield _prints(batch.column(0).to_pylist(), per_doc)

    return rows.mapInArrow(run, SCHEMA)


def _by_join(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The same for a lexicon that is too large to broadcast: (document, term) rows meet it by the term's hash."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            w = Words(texts)
            at = distinct_terms(w)
            keys = batch.column(2).take(pa.array(w.of[at]))
            yield pa.RecordBatch.from_arrays([keys, _signed(w.hash[at]), pa.array(w.strings(at), pa.string())], names=["row", "term", "word"])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _prints(b.column(0).to_pylist(), [sorted(x or []) for x in b.column(1).to_pylist()])

    numbered = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    found = numbered.dropDuplicates(["row"]).mapInArrow(terms, "row long, term long, word string").join(lexicon, "term", "left_semi").groupBy("row").agg(F.collect_list("word").alias("words"))
    return numbered.select("doc_id", "row").join(found, "row", "left").select("doc_id", "words").repartition(shuffle_partitions(rows.sparkSession)).mapInArrow(prints, SCHEMA)
