"""Long spans that repeat across documents, from a compacted de Bruijn graph of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut
from .common import HELD, U, Words, bitmap, bits_for, in_bitmap, inside, look_up, mix, powers, prefix_hash, text_slices, windows

LEAST_WORDS = 50


def slide(a: np.ndarray, width: int, op: Callable) -> np.ndarray:
    """``op`` (minimum or maximum) over every run of ``width`` values, by doubling."""
    span = 1
    while 2 * span <= width:
        a, span = op(a[:-span], a[span:]), 2 * span
    return op(a[: len(a) - (width - span)], a[width - span :]) if width > span else a


class Edges:
    """The k-word windows of texts and their seeds.  ``ok`` marks the window starts that lie in one text; ``least`` is the least
    of the seed hashes of each window, where a seed is half as long as a window."""

    def __init__(self, texts: pa.Array, k: int) -> None:
        self.w = Words(texts)
        self.h = self.w.hash
        n = len(self.h)
        self.ok = np.zeros(n, bool)
        self.ok[inside(self.w.row, n, k)] = True
        seed = k // 2
        self.wide = k - seed + 1
        self.seeds = windows(self.h, seed)
        self.least = np.zeros(n, U)
        if n >= k:
            m = slide(self.seeds, self.wide, np.minimum)
            self.least[: len(m)] = np.where(self.ok[: len(m)], m, U(0))

    def chosen(self) -> np.ndarray:
        """Hashes of the seeds that are least in a window, once for each place."""
        if len(self.h) < len(self.h) - len(self.seeds) + self.wide or not self.ok.any():
            return self.seeds[:0]
        m = self.least[: len(self.seeds) - self.wide + 1]
        pad = np.zeros(self.wide - 1, U)
        return self.seeds[slide(np.concatenate((pad, m, pad)), self.wide, np.maximum) == self.seeds]


def _spans(docs: DataFrame, k: int, held: int) -> DataFrame:
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).filter(F.length("text") >= 2 * k - 1)
    # equal texts are walked once, with the weight of all their documents
    ids = cut(rows.groupBy("t", "doc_id").agg(F.count("*").alias("r")))
    first = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "r")
    copies = ids.groupBy("t").agg(F.count("*").alias("m"), F.min(first).alias("p"), F.sum("r").alias("n")).filter("m > 1 or p.r > 1")
    copies = cut(copies.select("t", F.col("p.doc_id").alias("p"), F.col("m").cast("double").alias("m"), (F.col("m") / F.col("p.r")).alias("w"), "n"))
    walked = look_up(rows, copies, "t", "n", "doc_id", "left", held).filter(F.col("m").isNull() | F.col("doc_id").eqNullSafe(F.col("p")))
    walked = walked.select("t", F.coalesce("w", F.lit(1.0)).alias("w"), F.coalesce("m", F.lit(1.0)).alias("m"), "text")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, "text"):
            value, n = np.unique(Edges(texts, k).chosen(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["seed", "n"])

    again = cut(walked.mapInArrow(seeds, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed"))
    log2 = bits_for(again.count())
    bits = spark.sparkContext.broadcast(bitmap(again, "seed", log2))

    def found(ends: tuple[Broadcast, int] | None) -> DataFrame:
        """``node, link, t, pos, w, sum`` of the nodes whose edges may repeat; with ``ends`` only of those that may be among these.
        ``link`` holds 31 bits of the words before and after, ``sum`` a hash of all words before the node that differences give spans of."""

        def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_slices(batches, "text"):
                e = Edges(texts, k)
                n = len(e.h)
                node = windows(e.h, k - 1)
                if not len(node):
                    continue
                out_edge = e.ok[: len(node)]
                in_edge = np.concatenate(([False], e.ok[: len(node) - 1]))
                maybe = e.ok & in_bitmap(bits.value, e.least, log2)
                copied = batch.column(2).to_numpy() > 1.5
                of = e.w.of[: len(node)]
                emit = maybe[: len(node)] | np.concatenate(([False], maybe[: len(node) - 1])) | (copied[of] & (in_edge != out_edge))
                at = np.flatnonzero(emit)
                if ends is not None:
                    at = at[in_bitmap(ends[0].value, node[at], ends[1])]
                word = (e.h & U(0x7FFFFFFF)).astype(np.int64) | 1
                after = np.where(out_edge[at], word[np.minimum(at + k - 1, n - 1)], 0)
                before = np.where(in_edge[at], word[at - 1], 0)
                row = pa.array(of[at])
                begin = e.w.row[of[at]]
                columns = [pa.array(node[at].view(np.int64)), pa.array((before << 32) | after)]
                names = ["node", "link", "w"]
                if ends is None:
                    columns.append(batch.column(1).take(row))
                else:
                    sums = np.concatenate((prefix_hash(mix(e.h, 41)), [U(0)]))
                    value = (sums[at] - sums[begin]) * powers(n + 1)[1][begin]
                    columns += [batch.column(1).take(row), batch.column(0).take(row), pa.array((at - begin).astype(np.int32)), pa.array(value.view(np.int64))]
                    names += ["t", "pos", "sum"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return walked.mapInArrow(nodes, "node long, link long, w double" + ", t long, pos int, sum long" * (ends is not None))

    # most nodes are interior to a path, or have edges that occur once: three aggregates of a node, made before the shuffle, tell
    after, before = F.expr("link & 4294967295"), F.shiftright("link", 32)
    met = found(None).groupBy("node").agg(F.sum("w").alias("c"), F.min("link").alias("lo"), F.max("link").alias("link"))
    judged = cut(met.filter((F.col("lo") != F.col("link")) | ((F.col("c") > 1.5) & ((after == 0) | (before == 0)))).select("node"))
    log2n = bits_for(judged.count())
    some = found((spark.sparkContext.broadcast(bitmap(judged, "node", log2n)), log2n))
    # a node that passes the bitmap by chance passes with all its rows, and is found to be interior again
    ends = cut(some.groupBy("node", before.alias("before"), after.alias("after"), "t", "pos", "sum").agg(F.sum("w").alias("w")))  # a repeated row walks with a part of the weight
    # what else there is gets judged edge by edge: a node has as many rows here as it has different pairs of neighbours
    links = ends.groupBy("node", "before", "after").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    sums = links.withColumns({"ci": F.sum("w").over(Window.partitionBy("node", "before")), "co": F.sum("w").over(Window.partitionBy("node", "after"))})
    i, o = (F.when((F.col(x) > 0) & (F.col(c) > 1.5), F.col(x)).otherwise(0) for x, c in (("before", "ci"), ("after", "co")))
    sums = sums.select("node", "before", "after", i.alias("i"), o.alias("o"), "n").filter("i > 0 or o > 0")
    bounds = sums.groupBy("node").agg(F.min("i").alias("li"), F.max("i").alias("hi"), F.min("o").alias("lo"), F.max("o").alias("ho")).filter("li <> hi or lo <> ho or li = 0 or lo = 0")
    kept = cut(sums.join(bounds.select("node"), "node", "left_semi").select(F.xxhash64("node", "before", "after").alias("e"), F.col("node").alias("of"), "o", "n"))
    placed = look_up(ends.withColumn("e", F.xxhash64("node", "before", "after")), kept, "e", "n", "t", held=held).filter("node = of")
    by_text = Window.partitionBy("t").orderBy("pos")
    paths = placed.withColumns({x: F.lead(y).over(by_text) for x, y in (("stop", "pos"), ("last", "node"), ("sum2", "sum"))}).filter("o > 0 and stop is not null")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Paths by all their words: the hash of those before the last node, from the source's coordinates, and both end nodes."""
        for b in batches:
            pos = b.column(1).to_numpy()
            node, last, lo, hi = (b.column(c).to_numpy().view(U) for c in (4, 5, 6, 7))
            words = (hi - lo) * powers(int(pos.max(initial=0)) + 1)[1][pos]
            path = mix(node ^ mix(words ^ mix(last, 42), 43), 44)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(path.view(np.int64)), b.column(3)], names=["t", "pos", "stop", "path", "w"])

    columns = ("t", "pos", "stop", "w", "node", "last", "sum", "sum2")
    paths = cut(paths.select(*columns).distinct().mapInArrow(known, "t long, pos int, stop int, path long, w double"))
    # the paths that several sources walk
    sources = cut(paths.groupBy("path").agg(F.sum("w").alias("n"), F.count("*").alias("rows")).filter("n > 1.5"))
    sure = look_up(paths, sources, "path", "rows", "t", held=held).withColumn("fresh", F.when(F.lag("stop").over(by_text) == F.col("pos"), 0).otherwise(1))
    spans = sure.withColumn("g", F.sum("fresh").over(by_text)).groupBy("t", "g").agg(F.min("pos").alias("pos"), F.max("stop").alias("stop"), F.count("*").alias("n_paths"), F.max("n").alias("copies"))
    # a text has few spans but any number of documents
    many = copies.select("t", F.col("n").alias("n_docs"))
    spans = cut(spans.join(many, "t", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(1))))
    return look_up(ids.select("t", "doc_id"), spans, "t", "n_docs", "doc_id", held=held)


def repeated_spans(docs: DataFrame, least: int = LEAST_WORDS, held: int = HELD) -> DataFrame:
    """``doc_id, first_word, n_words, n_paths, copies``: the maximal spans of a document of which every window of ``least`` words
    also occurs elsewhere, in another document or at another place of this one.

    Edges are windows of ``least`` words, nodes the words that two edges share.  A node that all its sources enter by one
    repeated edge and leave by one repeated edge is inside a path, all others end paths; so every source walks paths from end to
    end.  Paths of two sources are the same if a hash of all their words, taken at each source's coordinates, and the hashes of
    both end nodes agree.  ``n_paths`` counts the paths that a span compacts to,
    ``copies`` the occurrences of its most frequent path.  Only windows whose least half-length seed occurs twice
    (a bitmap of bounded size knows which) become edges: any repeated window is among them.

    Equal texts are walked once with the weight of their documents; rows that repeat doc_id and text count once.  Null, empty and
    short texts and empty tables have no spans; texts may be of any length; null ids stay null; other columns are ignored,
    whatever their names.  Beyond ``held`` rows, tables of texts, nodes and paths are joined instead of broadcast."""
    s = _spans(docs, least, held)
    return s.select("doc_id", F.col("pos").cast("long").alias("first_word"), (F.col("stop") - F.col("pos") + least - 1).cast("long").alias("n_words"), F.col("n_paths"), F.round("copies").cast("long").alias("copies"))
