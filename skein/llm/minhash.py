"""Near-duplicate documents from bottom-k sketches of one hash function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.session import cut
from .common import U, Words, bitmap, bits_for, fresh, in_bitmap, inside, look_up, shuffle_partitions, text_slices, windows

SHINGLE, K, THRESHOLD, ESTIMATE = 3, 64, 0.5, 0.3
DIVIDED, LARGEST = 2_000, 50_000  # blocks of more texts are divided; more don't meet in one task


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and 63-bit hash of each run of ``width`` words; a shorter text is one shingle, one without words none."""
    w = Words(texts)
    h = w.hash
    at = inside(w.row, len(h), width)
    of, found = [w.of[at]], [windows(h, width)[at] if len(at) else h[:0]]
    count = np.diff(w.row)
    for n in range(1, width):
        few = np.flatnonzero(count == n)
        if len(few):
            of.append(few)
            found.append(windows(h, n)[w.row[:-1][few]])
    return np.concatenate(of), np.concatenate(found) >> U(1)


def shingle_sets(of: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each of n texts."""
    order = np.argsort(of, kind="stable")
    of, h = of[order], h[order]
    return [np.unique(x) for x in np.split(h, np.searchsorted(of, np.arange(1, n)))] if n else []


def bottom(of: np.ndarray, h: np.ndarray, n: int, k: int) -> list[np.ndarray]:
    """The k least distinct shingles of each text.  A bound that about 2 k hashes pass saves sorting the others; where it leaves
    fewer than k, all are sorted."""
    count = np.bincount(of, minlength=n)
    bound = np.where(count > 3 * k, (2.0**63) * (2 * k + 16) / np.maximum(count, 1), 2.0**63)
    low = h < bound[of].astype(U)
    out = [x[:k] for x in shingle_sets(of[low], h[low], n)]
    short = [i for i in range(n) if len(out[i]) < k and bound[i] < 2.0**63]
    if short:
        again = np.isin(of, short)
        for i, x in zip(short, shingle_sets(np.searchsorted(short, of[again]), h[again], len(short))):
            out[i] = x[:k]
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, U)]).view(np.int64)))


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard similarity as seen in the bottom-k sketch of the union, made from both sketches."""
    u = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.searchsorted(both, u[-1], "right") / len(u) if len(u) else 0.0


def exact(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def group_block(sets: list[np.ndarray], k: int, threshold: float, estimate: float, rounds: int = 4) -> list[int]:
    """For each set the least index of its group; groups are connected by pairs of at least the threshold.

    Inverted lists of the sketches give overlaps, the union sketch filters, exact Jaccard verifies.  A pair whose sets are already
    in one group needs no verifying.  First, in a few rounds, each set is verified with one other: of the sets that come first in its
    lists, in an order drawn anew, the one that does so in most.  Lists of which all sets are in one group then have no pair
    left and go, so that near copies of each other cost as much as they are many.  Every pair of sets of different groups in the
    other lists is compared, each once and from the smaller group's side: a set with all that it meets, those with most in common first, many at a time."""
    n = len(sets)
    root = np.arange(n)
    sketch = [s[:k] for s in sets]
    size, whole = np.array([len(s) for s in sketch]), np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    posting = np.repeat(np.arange(n), size)
    _, coded = np.unique(np.concatenate(sketch), return_inverse=True)
    order = np.argsort(coded, kind="stable")
    posting, code = posting[order], coded[order]
    place_of = np.zeros(len(code) and code[-1] + 1, np.int64)

    def open_lists() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lists of sets of several groups: their sets, where each begins, and how many it has."""
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        r = root[posting]
        several = np.minimum.reduceat(r, begin) < np.maximum.reduceat(r, begin) if len(r) else np.zeros(0, bool)
        count = np.diff(begin, append=len(code))
        return np.repeat(several, count), np.cumsum(count[several]) - count[several], count[several]

    def merge(a: int, j: int) -> None:
        x, y = root[a], root[j]
        if x != y:
            root[root == max(x, y)] = min(x, y)

    def estimated(a: int, b: np.ndarray) -> np.ndarray:
        """``union_estimate`` of set a with each of b: a common value's place in the union is the sum of its places in both, less
        the common values up to it."""
        place_of[coded[first[a] : first[a] + size[a]]] = np.arange(1, size[a] + 1)
        begin = np.cumsum(size[b]) - size[b]
        own = np.arange(size[b].sum()) - np.repeat(begin, size[b])
        other = place_of[coded[np.repeat(first[b], size[b]) + own]]
        place_of[coded[first[a] : first[a] + size[a]]] = 0
        common = np.cumsum(other > 0)
        before = np.repeat(common[begin] - (other[begin] > 0), size[b])
        low = (other > 0) & (other + own + 1 - (common - before) <= k)
        union = np.minimum(k, size[a] + size[b] - np.add.reduceat(other > 0, begin, dtype=np.int64))
        return np.add.reduceat(low, begin, dtype=np.int64) / union

    def similar(a: int, b: np.ndarray) -> np.ndarray:
        """``exact`` of set a with each of b; most values that a hasn't differ in their high bits from all that it has."""
        s = sets[a]
        high = np.zeros(1 << 16, bool)
        high[s >> U(47)] = True
        flat = np.concatenate([sets[j] for j in b.tolist()])
        may = np.flatnonzero(high[flat >> U(47)])
        may = may[s[np.minimum(np.searchsorted(s, flat[may]), len(s) - 1)] == flat[may]]
        both = np.diff(np.searchsorted(may, np.concatenate(([0], np.cumsum(whole[b])))))
        return both / (whole[a] + whole[b] - both)

    for turn in range(rounds + 1):
        kept, begin, count = open_lists()
        posting, code = posting[kept], code[kept]
        if turn == rounds or not len(posting):
            break
        place = np.random.default_rng(turn).permutation(n)
        head = np.repeat(np.argsort(place)[np.minimum.reduceat(place[posting], begin)], count)
        apart = root[posting] != root[head]
        pair, often = np.unique(posting[apart] * n + head[apart], return_counts=True)
        by_set = np.lexsort((often, pair // n))
        best = pair[by_set][np.diff(pair[by_set] // n, append=n) > 0]
        for a, j in zip((best // n).tolist(), (best % n).tolist()):
            if root[a] != root[j] and union_estimate(sketch[a], sketch[j], k) >= estimate and exact(sets[a], sets[j]) >= threshold:
                merge(a, j)
    if not len(posting):
        return root.tolist()
    group = np.bincount(root, minlength=n)[root] * n + root  # by size
    order = np.lexsort((group[posting], code))
    posting, code = posting[order], code[order]
    last = np.append(np.diff(code) > 0, True)
    ends, stops = np.flatnonzero(last | np.append(np.diff(group[posting]) != 0, True)) + 1, np.flatnonzero(last) + 1
    here = np.arange(len(posting))
    end, stop = ends[np.searchsorted(ends, here, "right")], stops[np.searchsorted(stops, here, "right")]  # of a set's group in a list, of the list
    some = np.flatnonzero(end < stop)
    some = some[np.argsort(posting[some], kind="stable")]
    row = np.searchsorted(posting[some], np.arange(n + 1))
    for a in np.flatnonzero(np.diff(row)).tolist():
        mine = some[row[a] : row[a + 1]]
        overlap = np.bincount(np.concatenate([posting[i:j] for i, j in zip(end[mine].tolist(), stop[mine].tolist())]))
        b = np.flatnonzero(overlap)
        both = overlap[b]
        ok = (both >= np.ceil(estimate * np.maximum(size[a], size[b]) - 1e-9)) & (root[b] != root[a])
        ok &= np.minimum(whole[a], whole[b]) >= threshold * np.maximum(whole[a], whole[b]) - 1e-9
        if whole[a] <= k:  # sketches that are the sets tell all they have in common
            ok &= (whole[b] > k) | (both >= threshold * (whole[a] + whole[b] - both) - 1e-9)
        b = b[ok][np.argsort(-both[ok], kind="stable")]
        many = 16
        while len(b):
            some_b, b, many = b[:many], b[many:], 256
            some_b = some_b[estimated(a, some_b) >= estimate]
            while len(some_b):
                few = max(1, int(np.searchsorted(np.cumsum(whole[some_b]), 1 << 20)))
                for j in some_b[:few][similar(a, some_b[:few]) >= threshold].tolist():
                    merge(a, j)
                some_b = some_b[few:]
            b = b[root[b] != root[a]]
    return root.tolist()


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).filter(F.length("text") > 0)


def _rarest(sets: DataFrame, share: float) -> DataFrame:
    """``t, v, n, e``: of the values ``v`` of each text those that other texts have too, without those that it can spare: two texts that have at
    least ``share`` of the larger's values in common have one of what is left in common.  A text has ``n`` values, and ``e`` of them, this
    one and those that come after it in the common order, may be what it shares with a text of which this is the first in common.

    How many texts have a value is aggregated before the shuffle; a bitmap of bounded size keeps most of the values that only one
    has from meeting these counts, and the rows of a hot value are spread over tasks."""
    spark = sets.sparkSession
    count = cut(sets.select(F.explode("v").alias("v")).groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"))
    log2 = bits_for(count.count())
    bits = spark.sparkContext.broadcast(bitmap(count.select(F.shiftleft("v", 1).alias("v")), "v", log2))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            v = b.column(1).flatten()
            at = pa.array(np.flatnonzero(in_bitmap(bits.value, v.to_numpy().view(U) << U(1), log2)))
            of = pa.array(np.repeat(np.arange(len(size)), size)).take(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(size).take(of), v.take(at)], names=["t", "n", "v"])

    each = sets.select("t", "v").mapInArrow(shared, "t long, n long, v long")
    by_text = Window.partitionBy("t")
    need = F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9))
    ranked = look_up(each, count, "v", "df", "t", held=0).withColumns({"c": F.count("*").over(by_text), "r": F.row_number().over(by_text.orderBy("df", "v"))})
    return ranked.filter(F.col("r") <= F.col("c") - need + 1).select("t", "v", "n", (F.col("c") - F.col("r") + 1).alias("e"))


def _links(lists: DataFrame, most) -> DataFrame:
    """``a, b``: links that connect the texts that a value and their sizes allow to be near; no pairs are formed within a value.

    Whatever two near texts have in common lies, for both, at or after the first value that they share.  So each allows the other a
    size of at most ``most``, an expression of ``n`` and ``e``, and texts that have a passage in common but are too different in size, or have too little left, aren't
    linked by it.  A text whose own size is more than it allows can be near only to smaller ones that allow its size.  In order of the
    sizes that each must meet, one link to the text so far that allows most does for all: whatever else allows the size allows it at the same
    place, and was linked to that one.  A value's rows, four numbers each, are sorted in one task."""
    sized = lists.withColumn("m", most)
    wide = F.col("m") >= F.col("n")
    before = Window.partitionBy("v").orderBy(F.least("m", "n"), wide.desc(), "t").rowsBetween(Window.unboundedPreceding, -1)
    first = F.max(F.when(wide, F.struct("m", "t"))).over(before)
    return sized.withColumn("f", first).filter(F.col("f.m") >= F.col("n")).select(F.col("t").alias("a"), F.col("f.t").alias("b"))


def _divided(sets: DataFrame, threshold: float) -> DataFrame:
    """``t, block`` for texts in large blocks: what their exact sets connect.  Two sets with a similarity of at least the threshold
    have that share of the larger in common, so the rarest elements of each that it can't spare do for them what those of sketches do for
    texts in general, but without their error, and passages that take up less of a text connect nothing.  Of two sets of n and n' elements
    t / (1 + t) (n + n') are in common, which bounds n' by what is left of either."""
    most = F.floor(F.col("e") * F.lit((1 + threshold) / max(threshold, 1e-9)) + F.lit(1e-6)) - F.col("n")
    found = components(_links(_rarest(sets.select("t", F.col("s").alias("v")), threshold), most))
    return found.select(F.col("node").alias("t"), F.col("root").alias("block"))


def _verified(sets: DataFrame, lists: DataFrame, first: DataFrame, k: int, threshold: float, estimate: float, rounds: int = 4) -> DataFrame:
    """``t, root`` of texts ``block, t, s`` in blocks too large for a task; ``lists`` has the values ``v`` that link them.

    In each round every text is verified with one other of another part of its block: of the texts that come first in its lists, in an
    order drawn anew, the one that does so in most.  Near copies of each other mostly have the same one, so that they become one part
    however many they are.  Then the pairs are verified that have a value in common and aren't in one part yet: their number is the
    product of the sizes of the parts that share a value."""
    sketches = cut(first.join(sets.select("t"), "t").select("t", F.array_sort("v").alias("z")))
    whole = cut(sets.select("t", "s"))

    def beside(pairs: DataFrame, table: DataFrame, x: str) -> DataFrame:
        """``x1, x2``: what the table has of both ends of pairs; an end of a great number of pairs is spread over tasks."""
        for end, name, by in (("a", f"{x}1", "b"), ("b", f"{x}2", "a")):
            often = pairs.groupBy(end).agg(F.count("*").alias("n"))
            own = cut(table.select(F.col("t").alias(end), F.col(x).alias(name)).join(often, end))
            pairs = look_up(pairs, own, end, "n", by, held=0, hot=20_000).drop("n")  # rows are whole sets here
        return pairs

    def near(pairs: DataFrame) -> DataFrame:
        """Those pairs ``a, b`` that the union sketch and the exact sets confirm."""
        union = F.slice(F.array_sort(F.array_union("z1", "z2")), 1, k)
        both = F.filter(F.array_intersect("z1", "z2"), lambda x: x <= F.element_at(union, -1))
        close = cut(beside(pairs, sketches, "z").filter(F.size(both) >= estimate * F.size(union)).select("a", "b"))
        same = F.size(F.array_intersect("s1", "s2"))
        return beside(close, whole, "s").filter(same >= threshold * (F.size("s1") + F.size("s2") - same)).select("a", "b")

    links = sets.sparkSession.createDataFrame([], "a long, b long")
    listed = cut(lists.select("v", "t", F.col("t").alias("root")))
    for n in range(rounds):
        order = F.xxhash64("t", F.lit(n))
        heads = listed.groupBy("v").agg(F.min(F.struct(order.alias("o"), "t", "root")).alias("m"), F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        away = look_up(listed, cut(heads.filter("lo < hi").select("v", F.col("m.t").alias("b"), F.col("m.root").alias("other"), "n")), "v", "n", "t", held=0).filter("root <> other")
        one = away.groupBy("t", "b").agg(F.count("*").alias("c")).groupBy(F.col("t").alias("a")).agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        one = cut(one, forget=True)
        if one.isEmpty():
            break
        links = cut(links.union(near(one)), forget=True)
        listed = cut(listed.drop("root").join(components(links), F.col("t") == F.col("node"), "left").select("v", "t", F.coalesce("root", "t").alias("root")), forget=True)
    several = listed.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("v")
    listed = cut(listed.join(several, "v", "left_semi"))
    other = listed.select("v", F.col("t").alias("b"), F.col("root").alias("other"))
    pairs = cut(listed.select("v", F.col("t").alias("a"), "root").join(other, "v").filter("a < b and root <> other").select("a", "b").distinct())
    return cut(components(links.union(near(pairs)))).select(F.col("node").alias("t"), "root")


def text_groups(docs: DataFrame, width: int = SHINGLE, k: int = K, threshold: float = THRESHOLD, estimate: float = ESTIMATE, held: int = 2_000_000, divided: int = DIVIDED, largest: int = LARGEST) -> DataFrame:
    """``t, root``: the hash of a text and its group, for texts that are in a group with another text.

    Texts that are equal count once.  A text's sketch values in order of how many texts retain them, rarest first: two sketches
    with an estimate of at least e share at least e of the larger, so they share one among the first (1 - e) n + 1.  Where
    what follows it and the sizes allow that (``_links``), they are linked; what is so connected forms a block, and the sets of a block meet in one task.  Blocks of more than
    ``divided`` texts, which weak links chain together, are first divided by their exact sets in the same way (``_divided``); where more than
    ``largest`` texts remain, a great number of near copies of each other, they are verified by joins (``_verified``).  Where at most ``held`` texts are in
    blocks, their hashes are broadcast, else joined."""
    spark = docs.sparkSession
    rows = _texts(docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(bottom(*shingles(texts, width), len(texts), k))], names=["t", "v"])

    first = cut(rows.select("t", "text").mapInArrow(sketch, "t long, v array<long>").filter(F.size("v") > 0).dropDuplicates(["t"]))
    lists = cut(_rarest(first, estimate))
    most = F.floor(F.col("e") / F.lit(max(estimate, 1e-9)) + F.lit(1e-6))
    blocks = cut(components(_links(lists, most)).select(F.col("node").alias("t"), F.col("root").alias("block")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_slices(batches, "text"):
            of, h = shingles(texts, width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(shingle_sets(of, h, len(texts)))], names=["block", "t", "s"])

    def members(of: DataFrame) -> DataFrame:
        """``block, t, s``: the set of each text of some blocks, from one of its documents."""
        once = rows.groupBy("t").agg(F.min("doc_id").alias("doc_id"))
        chosen = cut(of.join(once, "t").select("t", "block", "doc_id"))
        n = chosen.count()
        if n == 0:
            return spark.createDataFrame([], "block long, t long, s array<long>")
        if n > held:  # the key is a document, so a text that many have isn't hot
            same = chosen.select(F.col("t").alias("u"), "block", F.col("doc_id").alias("d"))
            return rows.join(same, (F.col("t") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("block", "t", "text").mapInArrow(sets, "block long, t long, s array<long>")
        table = chosen.toArrow()
        t = table.column("t").to_numpy()
        order = np.argsort(t)
        none = np.iinfo(np.int64).min
        sent = spark.sparkContext.broadcast((t[order], table.column("block").to_numpy()[order], table.column("doc_id").fill_null(none).to_numpy()[order]))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, block, doc = sent.value
            for batch in batches:
                mine = batch.column(1).to_numpy()
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                ok = (known[at] == mine) & (doc[at] == batch.column(0).fill_null(none).to_numpy())
                yield from sets(iter([pa.RecordBatch.from_arrays([pa.array(block[at]), batch.column(1), batch.column(2)], names=["block", "t", "text"]).filter(pa.array(ok))]))

        return rows.mapInArrow(placed, "block long, t long, s array<long>")

    over = lambda b, most: cut(b.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    within = lambda b, some, how: look_up(b, some, "block", "n", "t", how, held).drop("n")
    large, verified = over(blocks, min(divided, largest)), None
    if not large.isEmpty():
        inside = cut(members(within(blocks, large, "inner")).dropDuplicates(["t"]))
        finer = cut(_divided(inside, threshold))
        blocks = cut(within(blocks, large, "left_anti").select("t", "block").union(finer.select("t", "block")))
        hard = over(finer, largest)
        if not hard.isEmpty():
            apart = cut(within(inside.drop("block").join(finer, "t"), hard, "inner").select("block", "t", "s"))
            verified = _verified(apart, lists.join(apart.select("t"), "t", "left_semi"), first, k, threshold, estimate)
            blocks = within(blocks, hard, "left_anti")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held_ = None, [], []

        def done() -> pa.RecordBatch:
            t = np.array(ids, np.int64)
            roots = t[group_block(held_, k, threshold, estimate)]
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(roots)], names=["t", "root"])

        for batch in batches:
            flat, at = batch.column(2).values.to_numpy().view(U), batch.column(2).offsets.to_numpy()
            for i, (block, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if block != now:
                    if len(ids) > 1:
                        yield done()
                    now, ids, held_ = block, [], []
                if not ids or ids[-1] != t:
                    ids.append(t)
                    held_.append(flat[at[i] : at[i + 1]].copy())
        if len(ids) > 1:
            yield done()

    together = members(blocks).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "t").mapInArrow(grouped, "t long, root long")
    out = cut(together if verified is None else together.union(verified))
    several = out.groupBy("root").count().filter("count > 1").select("root")
    return out.join(several, "root").select("t", "root")


def duplicate_rows(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, t, root, keep_id``: the rows of every group of two and more rows; ``keep_id`` is the group's least doc_id."""
    groups = text_groups(docs, **options)
    word = "[0-9A-Za-z\\x{C0}-\\x{1FFF}\\x{2080}-\\x{2FFF}\\x{3040}-\\x{10FFFF}]"
    ids = _texts(docs).filter(F.col("text").rlike(word)).select("doc_id", "t")
    placed = cut(look_up(ids, cut(groups), "t", how="left", held=options.get("held", 2_000_000)).withColumn("root", F.coalesce("root", "t")))
    kept = cut(placed.groupBy("root").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1"))
    return look_up(placed, kept, "root", "n", "doc_id", held=options.get("held", 2_000_000)).select("doc_id", "t", "root", "keep_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, kept_doc_id``: each document that falls to another of its group, and the one that stays, the least id.

    Documents whose sets of ``width``-word shingles have a Jaccard similarity of at least ``threshold`` are near; groups are what
    such pairs connect.  A text of fewer words is one shingle; a text without words, empty or null, is nobody's duplicate, and an
    empty table has none; a text of any length is compared as a whole.  Two texts count as near only if their sketches (the ``k`` least
    hashes) estimate at least ``estimate`` as well, which pairs at the threshold miss about once in a thousand.  Rows that repeat a doc_id
    count once; a null id falls to any other.  Other columns are ignored, whatever their names."""
    return duplicate_rows(docs, **options).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", F.col("keep_id").alias("kept_doc_id")).distinct()


def without_near_duplicates(docs: DataFrame, held: int = 2_000_000, **options) -> DataFrame:
    """The rows of ``docs`` less all but one of each group; all columns stay.  The one has the group's least doc_id (the least text
    hash among repeated ids); of rows that are the same in both, one stays.  Rows without words, also null and empty ones, all stay; an
    empty table stays one; added columns may have any name."""
    h, t, root, keep_t, keep_id = fresh(docs, "h", "t", "root", "keep_t", "keep_id")
    found = cut(duplicate_rows(docs, held=held, **options))
    one = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("root").agg(F.min("t").alias(keep_t), F.first("keep_id").alias(keep_id))
    table = cut(found.select(F.col("t").alias(t), "root").distinct().join(one, "root").withColumnRenamed("root", root))
    if table.count() <= held:
        table = F.broadcast(table)
    marked = docs.withColumn(h, F.xxhash64(F.col("text").cast("string"))).join(table, F.col(h) == F.col(t), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = marked.filter((F.col(h) == F.col(keep_t)) & F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id))).dropDuplicates([root])
    return marked.filter(F.col(root).isNull()).select(*columns).union(first.select(*columns))
