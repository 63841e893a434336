"""Connected components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from .session import cut

AT_ONCE = 1 << 20  # edges that are joined within a task


def least_linked(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node that each of the nodes 0 to n - 1 is connected with by the links x, y: roots hang on smaller ones that they are linked
    with, until no link is left between two."""
    root = np.arange(n)
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def contracted(e: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Edges ``a, b`` with the same components and never more of them: of each run of ``at_once`` edges within a partition every node
    hangs on the least that they connect it with.  Ids that are neither strings nor whole numbers are left as they are."""
    kind = e.schema["a"].dataType
    if e.schema["b"].dataType != kind or not isinstance(kind, (StringType, IntegralType)):
        return e

    def done(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.chunked_array([b.column(i) for i in range(2) for b in batches]).combine_chunks()
        coded = pc.dictionary_encode(ends)
        ids = coded.dictionary
        order = pc.sort_indices(ids).to_numpy()
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        x, y = np.split(rank[coded.indices.to_numpy()], 2)
        root = least_linked(len(ids), x, y)
        hung = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(order[hung])), ids.take(pa.array(order[root[hung]]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= at_once:
                yield done(held)
                held, n = [], 0
        if n:
            yield done(held)

    return e.mapInArrow(run, e.select("a", "b").schema)


def are_stars(e: DataFrame) -> bool:
    """Whether every node of the distinct edges ``a, b`` hangs on one other that hangs on none."""
    ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("low")).union(e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up > 1 or up = 1 and low = 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b`` (of any type with an order): the root is the least node of its component.

    What lies in one partition is joined there first, so that edges which come together cost no rounds.  Each round hangs the larger
    neighbours of a node, then the smaller ones, on the least of them; edges never become more and
    end as stars about the roots after O(log^2) rounds; one look at their ends tells.  Null ends and loops are left out.  Every round is checkpointed.  The minimum
    of a node's neighbours is aggregated before the shuffle; where it is joined back, that side has one row a node, so AQE can split
    the neighbours of a hot one."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b and a is not null and b is not null")
    e = cut(contracted(e).distinct(), forget=True)
    for n in range(most_rounds + 1):
        if are_stars(e):
            roots = e.select("b").distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
        if n == most_rounds:
            raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # what lies above hangs on the least neighbour; links to smaller neighbours are made again from the other end
        e1 = large.filter("a > b").distinct()
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        both_ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = e1.join(low, "a").select(F.explode(both_ends).alias("x")).select("x.a", "x.b").filter("a > b").distinct()
        e = cut(small, forget=True)
