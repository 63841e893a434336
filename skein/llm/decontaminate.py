"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, runs of ``width`` template tokens of documents and benchmark items
are hash-joined, and of an alignment of a document with an item those windows count whose slot values each stand for one
value of the document throughout, or that agree word for word.  A question whose numbers or names were exchanged is therefore found as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut
from .common import U, Words, bitmap, bits_for, in_bitmap, inside, mix, text_slices, windows, word_hash

UNITS = tuple(
    "mm cm m km kilometers kilometres meters metres miles mile feet foot inch inches g kg mg gram grams kilogram kilograms pounds "
    "lb lbs ounces l ml liter liters litre litres gallons s sec seconds second min minutes minute h hours hour days day weeks "
    "week months month years year dollars dollar cents euros euro eur usd percent degrees mph kmh kg kwh watts volts".split()
)
WORD, NUM, NAME, UNIT = range(4)
SHOWN = ("", "<num>", "<name>", "<unit>")
_PLACE = mix(np.arange(4, dtype=U) + U(1000), 11)


class Templates:
    """Template tokens of texts: ``key`` to hash, ``kind``, the span ``start``/``end`` in ``words.data``, and ``row`` as in Words.

    A number is a word that begins with a digit; numbers that one of ``. , : /`` separates are one.  A name is a word whose
    first letter is a capital and that follows a single space (so it isn't first in its sentence); names in a row are one.  A
    unit is a word of UNITS after a number."""

    def __init__(self, texts: pa.Array, units: np.ndarray) -> None:
        self.words = w = Words(texts)
        o = Words(texts, lower=False)
        n = len(w.start)
        kind = np.zeros(n, np.int8)
        h = w.hash
        if n:
            a, b = o.data[o.start], w.data[w.start]
            capital = a != b
            for k, least in ((1, 0xC0), (2, 0xE0)):
                at = np.flatnonzero(a >= least)
                capital[at] |= o.data[np.minimum(o.start[at] + k, len(o.data) - 1)] != w.data[np.minimum(w.start[at] + k, len(w.data) - 1)]
            first = np.zeros(n, bool)
            first[w.row[:-1][w.row[:-1] < w.row[1:]]] = True
            close = np.concatenate(([False], o.start[1:] - o.end[:-1] == 1)) & ~first
            between = np.concatenate(([0], o.data[o.end[:-1]]))
            kind[(b >= 48) & (b <= 57)] = NUM
            kind[capital & close & (between == 32) & (kind == WORD)] = NAME
            joins = close & (kind == np.concatenate(([-1], kind[:-1]))) & (((kind == NUM) & np.isin(between, [44, 46, 47, 58])) | ((kind == NAME) & (between == 32)))
            keep = np.flatnonzero(~joins)
            end = w.end[np.concatenate((keep[1:], [n])) - 1]
            row = np.searchsorted(keep, w.row)
            kind, start, h, first = kind[keep], w.start[keep], h[keep], first[keep]
            after = np.concatenate(([False], kind[:-1] == NUM)) & ~first
            kind[after & (kind != NUM) & np.isin(h, units)] = UNIT
            self.start, self.end, self.row = start, end, row
        else:
            self.start, self.end, self.row = w.start, w.end, w.row
        self.kind = kind
        self.key = np.where(kind == WORD, h, _PLACE[kind])

        self.same = self.words.span_hash(self.start, self.end)

    def windows(self, width: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows within one text, whether they have too few literal words, and their hashes, which are then those of
        the tokens as they stand."""
        at = inside(self.row, len(self.key), width)
        if not len(at):
            return at, np.zeros(0, bool), np.zeros(0, U)
        lit = np.concatenate(([0], np.cumsum(self.kind == WORD)))
        few = lit[at + width] - lit[at] < literals
        return at, few, np.where(few, mix(windows(self.same, width)[at], 12), windows(self.key, width)[at])

    def show(self, at: int, width: int, raw: bytes, few: bool) -> tuple[str, list[str]]:
        """A window's template, and its slot values, each with its kind.  With ``few`` literal words the template is the text
        itself after a ``=``, which no template has."""
        spans = [(self.kind[i], raw[self.start[i] : self.end[i]].decode()) for i in range(at, at + width)]
        template = "= " + " ".join(t for _, t in spans) if few else " ".join(SHOWN[k] or t for k, t in spans)
        return template, [f"{SHOWN[k]}{t}" for k, t in spans if k != WORD]


def _windows(df: DataFrame, id_col: str, text: str, width: int, literals: int, item: bool, bits=None, log2: int = 0, widths: tuple[int, ...] = ()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = word_hash(list(UNITS))
        for batch, texts in text_slices(batches, "text"):
            t = Templates(texts, units)
            raw, ids = t.words.data.tobytes(), batch.column(0)
            of = np.repeat(np.arange(len(texts)), np.diff(t.row))
            rows: dict[str, list] = {"id": [], "pos": [], "total": [], "width": [], "key": [], "template": [], "slots": []}
            counts = np.diff(t.row)
            for wide in sorted(set(np.minimum(counts[counts > 0], width).tolist())) if item else widths:
                at, few, h = t.windows(wide, min(literals, wide))
                if item:
                    keep = np.minimum(counts[of[at]], width) == wide
                else:
                    keep = in_bitmap(bits.value, h, log2)
                for i, f, k in zip(at[keep].tolist(), few[keep].tolist(), h[keep].tolist()):
                    template, slots = t.show(i, wide, raw, f)
                    rows["id"].append(ids[int(of[i])].as_py())
                    rows["pos"].append(i - int(t.row[of[i]]))
                    rows["total"].append(int(counts[of[i]]) - wide + 1)
                    rows["width"].append(wide)
                    rows["key"].append(k - (1 << 64) if k >> 63 else k)
                    rows["template"].append(template)
                    rows["slots"].append(slots)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("total", pa.int32()), ("width", pa.int32()), ("key", pa.int64()), ("template", pa.string()), ("slots", pa.list_(pa.string()))]))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(run, "id long, pos int, total int, width int, key long, template string, slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, literals: int = 4, enough: int = 6, share: float = 0.5) -> DataFrame:
    """Documents that contain benchmark items: ``doc_id, item_id, matched, item_windows, first_token, slots``.

    A pair is reported if, on one alignment, the template windows that agree number at least ``enough`` or ``share`` of the
    item's, whichever is less.  Windows with a slot value of the item that stands for two values of the document on the alignment,
    besides those that agree word for word, don't count.
    ``matched`` is the most on one alignment, ``first_token`` the first place in the document, ``slots`` the largest number of
    different slot values in the windows that count on one.  An item shorter than ``width`` is one window of its own length; windows with fewer
    than ``literals`` ordinary words (or their length, if less) match only word for word.  Rows whose id or text is null are left out; empty
    texts match nothing, and if either table is empty nothing is reported; repeated rows count once; texts of any length are searched as a
    whole; other columns are ignored, whatever their names.

    The benchmark's windows set a bitmap of bounded size, which lets few windows of documents through to the join; whatever the
    benchmark's size, the join alone decides."""
    spark = docs.sparkSession
    items = cut(_windows(benchmark, "item_id", "text", width, literals, True).distinct())
    n = items.count()
    widths = tuple(sorted(r[0] for r in items.select("width").distinct().collect()))
    log2 = bits_for(n)
    bits = spark.sparkContext.broadcast(bitmap(items, "key", log2))
    found = _windows(docs, "doc_id", "text", width, literals, False, bits, log2, widths)
    i = items.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("total").alias("item_windows"), "template", F.col("slots").alias("item_slots"))
    hits = found.select(F.col("id").alias("doc_id"), "pos", "template", "slots").join(i, "template")
    hits = hits.withColumn("slots", F.when(F.col("template").startswith("="), F.col("item_slots")).otherwise(F.col("slots")))
    lined = hits.groupBy("doc_id", "item_id", "item_windows", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set(F.struct("item_pos", "pos", "item_slots", "slots")).alias("hits")
    )
    enough_of = F.least(F.lit(enough), F.ceil(F.col("item_windows") * F.lit(share)))
    pairs = F.array_distinct(F.flatten(F.transform(F.filter("hits", lambda x: x.item_slots != x.slots), lambda x: F.arrays_zip(x.item_slots.alias("a"), x.slots.alias("b")))))
    lined = lined.filter(F.size("hits") >= enough_of).withColumn("pairs", pairs)
    clash = F.when(F.size("pairs") == F.size(F.array_distinct("pairs.a")), F.array().cast("array<string>")).otherwise(
        F.transform(F.filter("pairs", lambda x: F.size(F.filter("pairs", lambda y: y.a == x.a)) > 1), lambda x: x.a)
    )
    counted = lined.withColumn("clash", clash).withColumn("hits", F.filter("hits", lambda x: (x.item_slots == x.slots) | ~F.arrays_overlap(x.item_slots, "clash")))
    counted = counted.withColumns({"matched": F.size(F.array_distinct("hits.item_pos")), "first_token": F.array_min("hits.pos"), "slots": F.size(F.array_distinct(F.flatten("hits.item_slots")))})
    sure = counted.filter(F.col("matched") >= enough_of)
    return sure.groupBy("doc_id", "item_id").agg(
        F.max("matched").cast("long").alias("matched"), F.max("item_windows").cast("long").alias("item_windows"), F.min("first_token").cast("long").alias("first_token"), F.max("slots").cast("long").alias("slots")
    )
