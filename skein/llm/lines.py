"""Line dedup by a deletion-neighbourhood join with an edit bound of one character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut, numbered
from .common import U, bitmap, bits_for, fresh, in_bitmap, look_up, mix, powers, prefix_hash, text_slices

LEAST = 16
BLOCKS = 16
SUBSTITUTED, LONGER, SHORTER = range(3)


class Lines:
    """The lines of texts, trimmed of spaces, tabs and carriage returns: text ``of``, number ``no``, span ``a`` to ``b`` in
    characters; only those of at least ``least`` characters."""

    def __init__(self, texts: pa.Array, least: int) -> None:
        ends = np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)))).astype(np.int64)
        self.chars = c = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        breaks = np.flatnonzero(c == 10)
        start, end = np.sort(np.concatenate((ends[:-1], breaks + 1)), kind="stable"), np.sort(np.concatenate((breaks, ends[1:])), kind="stable")
        count = np.diff(np.searchsorted(breaks, ends)) + 1
        of = np.repeat(np.arange(len(texts)), count)
        no = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        solid = np.flatnonzero((c != 32) & (c != 10) & (c != 9) & (c != 13))
        i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
        some = np.flatnonzero(j > i)
        a, b = solid[i[some]], solid[j[some] - 1] + 1
        keep = b - a >= least
        self.of, self.no, self.a, self.b = of[some[keep]], no[some[keep]], a[keep], b[keep]
        self.n = self.b - self.a
        self.mixed = mix(c.astype(U) + U(1), 9)
        self.p = prefix_hash(self.mixed)
        self.inv = powers(len(self.p))[1]

    def sub(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of spans; the same characters give the same hash wherever they are."""
        return (self.p[b] - self.p[a]) * self.inv[a]

    @property
    def hash(self) -> np.ndarray:
        return mix(self.sub(self.a, self.b) ^ mix(self.n.astype(U), 3), 1)

    @property
    def check(self) -> np.ndarray:
        """32 more bits, from other hashes of the characters: equal lines are known by both."""
        q = prefix_hash(self.mixed * self.mixed)
        return (mix((q[self.b] - q[self.a]) * self.inv[self.a], 11) >> U(32)).astype(np.uint32).view(np.int32)

    def halves(self) -> np.ndarray:
        """Four keys a line.  Lines within one edit share the first half of the shorter, or what follows it: [2 d + i] has half i
        for a shorter line of n - d characters."""
        out = np.empty((len(self.a), 4), U)
        for d in (0, 1):
            short = self.n - d
            half = short // 2
            out[:, 2 * d] = mix(self.sub(self.a, self.a + half) ^ mix(short.astype(U), 4), 2)
            out[:, 2 * d + 1] = mix(self.sub(self.a + half + d, self.b) ^ mix(short.astype(U), 5), 2)
        return out

    def block(self, which: np.ndarray, d: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where block j of the lines' characters begins and ends, as a shorter line of n - d characters is divided."""
        short = self.n[which] - d
        return short * j // BLOCKS, short * (j + 1) // BLOCKS

    def but_block(self, which: np.ndarray, d: int, j: np.ndarray) -> np.ndarray:
        """Keys of lines without a block: lines that differ in one edit within it share theirs."""
        lo, hi = self.block(which, d, j)
        a, b = self.a[which], self.b[which]
        rest = self.sub(a, a + lo) + mix(self.sub(a + hi + d, b), 6)
        return mix(rest ^ mix((self.n[which] - d).astype(U) * U(BLOCKS) + j.astype(U), 7), 2)

    def without(self, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of a line with the character ``at`` deleted, as ``hash`` would give it."""
        a, b = self.a[which], self.b[which]
        x = self.sub(a, a + at) + (self.p[b] - self.p[a + at + 1]) * self.inv[a + 1]
        return mix(x ^ mix((self.n[which] - 1).astype(U), 3), 1)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index i and value for each value in lo[i] to hi[i]."""
    size = hi - lo
    i = np.repeat(np.arange(len(lo)), size)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + lo[i]


def _block_keys(x: Lines, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line, d, block and key of each block in which a line with matched halves ``ok`` may differ from another."""
    of, ds, js, keys = [], [], [], []
    for d in (0, 1):
        for i in (0, 1):  # if half i is matched the edit lies in the other
            which = np.flatnonzero(ok[:, 2 * d + i])
            j = np.tile(np.arange(BLOCKS // 2) + (BLOCKS // 2) * (1 - i), len(which))
            which = np.repeat(which, BLOCKS // 2)
            of.append(which)
            ds.append(np.full(len(which), d))
            js.append(j)
            keys.append(x.but_block(which, d, j))
    return tuple(np.concatenate(v) for v in (of, ds, js, keys))


def _neighbours(docs: DataFrame, unique: DataFrame, least: int) -> DataFrame:
    """``h, g, doc, line``: for each line within one edit of an earlier one, the earliest such place.

    The deletion neighbourhood, every line with one character less, is emitted where a partner is possible: two bitmaps of
    bounded size tell which halves of lines occur in two lines, then which blocks are all that sets two lines apart.  Bits that are set by
    chance let more through and change no result.  Variants with the same character left out at the same place are a
    substitution apart; a variant that equals a line is an insertion.  So each group of equal variants names one earliest line, and no
    pairs within a group are formed.  The edit distance of what remains is verified on the texts."""
    spark = docs.sparkSession
    unique = unique.filter("k0 is not null")
    matched = cut(unique.select(F.explode(F.array("k0", "k1", "k2", "k3")).alias("k")).groupBy("k").count().filter("count > 1").select("k"))
    log2 = bits_for(matched.count())
    bits = spark.sparkContext.broadcast(bitmap(matched, "k", log2))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, "text"):
            x = Lines(texts, least)
            ok = in_bitmap(bits.value, x.halves().ravel(), log2).reshape(-1, 4)
            at = np.flatnonzero(ok.any(axis=1))
            h, g = x.hash, x.check
            _, first = np.unique(h[at] ^ mix(g[at].astype(U)), return_index=True)
            at = at[first]
            some = np.zeros(len(ok), bool)
            some[at] = True
            of, _, _, keys = _block_keys(x, ok & some[:, None])
            order = np.argsort(of, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(ok))[np.sort(at)]))).astype(np.int32)
            at = np.sort(at)
            raw = x.chars
            shown = [raw[a:b].tobytes().decode("utf-32-le") for a, b in zip(x.a[at].tolist(), x.b[at].tolist())]
            mask = (ok[at] * np.array([1, 2, 4, 8])).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [_signed(h[at]), pa.array(g[at]), pa.array(shown, pa.string()), pa.array(mask, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), _signed(keys[order]))], names=["h", "g", "s", "m", "k"]
            )

    found = docs.select("text").mapInArrow(suspects, "h long, g int, s string, m int, k array<long>").dropDuplicates(["h", "g"])
    found = cut(found.join(unique.select("h", "g", "doc", "line"), ["h", "g"]))
    matched2 = cut(found.select(F.explode("k").alias("k")).groupBy("k").count().filter("count > 1").select("k"))
    log2b = bits_for(matched2.count())
    bits2 = spark.sparkContext.broadcast(bitmap(matched2, "k", log2b))
    # from here on a line is its place among the suspects, so that the least of a group is the least number
    some = cut(numbered(found.select("h", "g", "s", "m", "doc", "line"), "r", F.isnull("doc"), "doc", "line", "h", "g"))

    def emitted(hot: tuple[Broadcast, int] | None) -> DataFrame:
        """``key, role, r`` of every variant, or of those whose key may be among the ``hot`` ones."""

        def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_slices(batches, "s"):
                x = Lines(texts, 1)  # they are trimmed, so there is one for each text
                ok = (batch.column(1).to_numpy()[:, None] & np.array([1, 2, 4, 8])) > 0
                of, d, j, keys = _block_keys(x, ok)
                hit = in_bitmap(bits2.value, keys, log2b)
                of, d, j = of[hit], d[hit], j[hit]
                same = d == 0
                out = []
                lo, hi = x.block(of[same], 0, j[same])
                i, at = _spread(lo, hi)
                which = of[same][i]
                out.append((which, mix(x.without(which, at) + mix(at.astype(U), 8), 3), SUBSTITUTED))
                lo, hi = x.block(of[~same], 1, j[~same])
                i, at = _spread(lo, hi + 1)
                which = of[~same][i]
                out.append((which, x.without(which, at), LONGER))
                which = np.unique(of[same])
                out.append((which, x.hash[which], SHORTER))
                which, key = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                role = np.concatenate([np.full(len(o[0]), o[2]) for o in out])
                if hot is not None:
                    keep = in_bitmap(hot[0].value, key, hot[1])
                    which, key, role = which[keep], key[keep], role[keep]
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(role, pa.int32()), batch.column(2).take(pa.array(which))], names=["key", "role", "r"])

        return some.select("s", "m", "r").mapInArrow(variants, "key long, role int, r long")

    # the first line of each role in each group, aggregated before the shuffle; only groups of several lines go on
    least_of = {r: F.min(F.when(F.col("role") == r, F.col("r"))) for r in (SUBSTITUTED, LONGER, SHORTER)}
    groups = emitted(None).groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n"), *(least_of[r].alias(f"r{r}") for r in least_of))
    groups = cut(groups.filter("lo < hi").drop("lo", "hi"))
    log2c = bits_for(groups.count())
    v = emitted((spark.sparkContext.broadcast(bitmap(groups, "key", log2c)), log2c))
    other = F.when(F.col("role") == SUBSTITUTED, F.col(f"r{SUBSTITUTED}")).when(F.col("role") == LONGER, F.col(f"r{SHORTER}")).otherwise(F.col(f"r{LONGER}"))
    pairs = look_up(v, groups, "key", "n", "r").select("r", other.alias("o")).filter("o < r").distinct()
    text = some.select("r", "h", "g", "s", "doc", "line")
    near = pairs.join(text, "r").join(text.select(*(F.col(c).alias(f"o_{c}") for c in text.columns)), F.col("o_r") == F.col("o"))
    earlier = "struct(isnull(o_doc) as none, o_doc as doc, o_line as line) < struct(isnull(doc) as none, doc, line)"
    sure = near.filter(earlier).filter(F.levenshtein("s", "o_s", 1).between(0, 1))
    place = F.struct(F.isnull("o_doc").alias("none"), F.col("o_doc").alias("doc"), F.col("o_line").alias("line"))
    return sure.groupBy("h", "g").agg(F.min(place).alias("o")).select("h", "g", F.col("o.doc").alias("doc"), F.col("o.line").alias("line"))


def _fallen(docs: DataFrame, least: int, edits: int, shortest: int) -> DataFrame:
    """``doc, t, line, best``: every line that falls, with the hash of its text.  Lines of fewer than ``least`` characters have no
    keys ``k0`` to ``k3`` and so no neighbours."""
    if edits not in (0, 1):
        raise ValueError(f"edits = {edits}: only 0 and 1 are supported")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("t"), text.alias("text")).filter(F.length("text") >= shortest)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            x = Lines(texts, shortest)
            k, of, short = x.halves(), pa.array(x.of), x.n < least
            keys = [pa.array(np.ascontiguousarray(k[:, i]).view(np.int64), mask=short) for i in range(4)]
            yield pa.RecordBatch.from_arrays([_signed(x.hash), pa.array(x.check), batch.column(0).take(of), batch.column(1).take(of), pa.array(x.no, pa.int32()), *keys], names=["h", "g", "doc", "t", "line", "k0", "k1", "k2", "k3"])

    lines = cut(rows.mapInArrow(scan, "h long, g int, doc long, t long, line int, k0 long, k1 long, k2 long, k3 long"))
    place = F.struct(F.isnull("doc").alias("none"), "doc", "line")
    keys = [F.first(f"k{i}").alias(f"k{i}") for i in range(4)]
    unique = lines.groupBy("h", "g").agg(F.min(place).alias("p"), F.count("*").alias("n"), *keys)
    unique = cut(unique.select("h", "g", "n", F.col("p.doc").alias("doc"), F.col("p.line").alias("line"), *(f"k{i}" for i in range(4))))
    first = unique.filter("n > 1").select("h", "g", "doc", "line", F.lit(0).alias("edits"), "n")
    if edits:
        first = first.union(_neighbours(rows, unique, least).withColumns({"edits": F.lit(1), "n": F.lit(1)}))
    best = cut(first.groupBy("h", "g").agg(F.min(F.struct(F.isnull("doc").alias("none"), "doc", "line", "edits")).alias("best"), F.max("n").alias("n")))
    fell = look_up(lines.select("h", "g", "doc", "t", "line"), best.withColumnRenamed("g", "check"), "h", "n", "line")
    return fell.filter("g = check and struct(isnull(doc) as none, doc, line) > struct(best.none, best.doc, best.line)").select("doc", "t", "line", "best")


def repeated_lines(docs: DataFrame, least: int = LEAST, edits: int = 1, shortest: int = 1) -> DataFrame:
    """The lines that fall: ``doc_id, line, kept_doc_id, kept_line, edits``.

    Lines end at newlines, are trimmed of spaces, tabs and carriage returns, are numbered from 0 and count if they have at least
    ``shortest`` characters.  A line falls if one at an earlier (doc_id, line) is equal or, with ``edits`` = 1 and if both have at
    least ``least`` characters, is one inserted, deleted or substituted character away, whether or not that one falls itself;
    the earliest such place is named, and 0 or 1 ``edits``.  Other bounds of edits are refused.

    Null ids come last; lines at the same place, of rows that repeat an id, aren't earlier than each other.  Null and
    empty texts have no lines, nor have blank ones; an empty table gives no rows; repeated rows give the same lines once; texts and lines may be of any length;
    other columns are ignored, whatever their names."""
    fell = _fallen(docs, least, edits, shortest)
    return fell.select(F.col("doc").alias("doc_id"), F.col("line").cast("long").alias("line"), F.col("best.doc").alias("kept_doc_id"), F.col("best.line").cast("long").alias("kept_line"), F.col("best.edits").cast("long").alias("edits")).distinct()


def without_repeated_lines(docs: DataFrame, least: int = LEAST, edits: int = 1, shortest: int = 1) -> DataFrame:
    """``docs`` without the lines that ``repeated_lines`` names, and without the rows of which nothing but blanks is left then.

    A column ``n_chars`` is set to the new length of a text that has changed; all other columns stay, whatever their names.  Rows without
    such lines stay as they are, also null and empty ones; of repeated rows the lines fall, or stay, alike; an empty table stays one."""
    key, gone, t = fresh(docs, "key", "gone", "t")
    by_doc = _fallen(docs, least, edits, shortest).groupBy(F.col("doc").alias(key), F.col("t").alias(t)).agg(F.collect_set("line").alias(gone))
    text, lost = F.col("text").cast("string"), F.col(gone)
    joined = docs.join(by_doc, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(t)), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(lost, i)), "\n")
    out = {"text": F.when(lost.isNull(), text).otherwise(left)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(lost.isNull(), F.col("n_chars")).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType))
    changed = joined.withColumns(out)
    stays = lost.isNull() | (F.length(F.trim(F.translate("text", "\t\r\n", "   "))) > 0)
    return changed.filter(stays).select(*[F.col(f"`{c}`") for c in docs.columns])
