"""Session helpers and the vectorised word kernel that the operators share.

A *word* is a maximal run of characters of the lower-cased text, none of which is an ASCII character other
than a letter or digit, or lies in U+0080-00BF, U+2000-207F or U+3000-303F.  ``WORD_SQL`` is the same class as a
regular expression.  Words are found and hashed with numpy over the bytes of a whole Arrow batch: no Python
object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut

WORD_SQL = r"[0-9a-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+"
U = np.uint64
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = (1 << 20) - 64
HELD = 200_000  # rows of a few numbers that may be broadcast
HOT = 4_000_000  # rows of one key that may meet in one task


# ---------------------------------------------------------------- session


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, made unlike every column of ``df`` whatever the case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def look_up(rows: DataFrame, table: DataFrame, key: str, n: str | None = None, by: str | None = None, how: str = "inner", held: int = HELD, hot: int = HOT) -> DataFrame:
    """``rows`` joined with a ``table`` (a checkpoint) that has one row, or few, a key; ``rows`` may have any number.

    At most ``held`` rows of a table are broadcast.  Beyond that it is a shuffle join, in which only the rows of a hot key are
    many.  Where ``n``, a column of the table that counts them, says that they are more than ``hot``, they are spread by a
    hash of ``by`` over so many salts that about ``hot`` have each; every salt gets the table's row.  Such keys are at most a ``hot``-th of the
    rows, so they are broadcast."""
    if table.count() <= held:
        return rows.join(F.broadcast(table), key, how)
    if n is None:
        return rows.join(table, key, how)
    salts, salt = fresh(rows, "salts", "salt")
    many = F.when(F.col(n) > hot, F.ceil(F.col(n) / hot)).otherwise(1)
    known = table.filter(F.col(n) > hot).groupBy(key).agg(F.max(many).alias(salts))
    salted = rows.join(F.broadcast(known), key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(by), F.col(salts)), F.lit(0).cast("long"))).drop(salts)
    spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    return salted.join(spread, [key, salt], how).drop(salt)


# ---------------------------------------------------------------- Arrow


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of about ``limit`` bytes of text each (a longer text is a run of its own), with null text as ''."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.string()), "")
        lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            done = lengths[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(lengths, done + limit, "right")))
            yield batch.slice(at, to - at), pa.concat_arrays([texts.slice(at, to - at)])
            at = to
        del texts
        pa.default_memory_pool().release_unused()  # else the worker keeps what its largest batch took


def string_parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; the offsets begin at 0."""
    offsets = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


# ---------------------------------------------------------------- hashing


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:

        def run(base: int) -> np.ndarray:
            a = np.full(1 << max(12, n.bit_length()), base, U)
            a[0] = 1
            return np.multiply.accumulate(a)

        _POWERS[:] = run(BASE), run(pow(BASE, -1, 1 << 64))
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ U((seed * 0xD6E8FEB86659FD93) & (2**64 - 1))
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_hash(t: np.ndarray) -> np.ndarray:
    p, _ = powers(len(t) + 1)
    out = np.zeros(len(t) + 1, U)
    np.cumsum(t * p[: len(t)], out=out[1:])
    return out


def windows(t: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values; one for each start, none if there are too few values."""
    n = len(t) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    p = prefix_hash(t)
    return mix((p[width:] - p[:n]) * powers(n)[1], width)


_BYTE = mix(np.arange(256, dtype=U) + U(1), 7)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_mask(b: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    m = _IS_WORD[b]
    if len(b) and b.max() >= 0x80:
        for at in np.flatnonzero(b == 0xC2), np.flatnonzero((b[:-1] == 0xE2) & ((b[1:] & 0xFE) == 0x80)), np.flatnonzero((b[:-1] == 0xE3) & (b[1:] == 0x80)):
            width = 2 if len(at) and b[at[0]] == 0xC2 else 3
            for k in range(width):
                m[np.minimum(at + k, len(b) - 1)] = False
    return m


class Words:
    """Words of an array of texts: ``hash``, first byte ``start`` and end ``end`` of each in ``data``; the words of text i are
    ``row[i]`` to ``row[i + 1]``; ``of`` gives each word's text."""

    def __init__(self, texts: pa.Array, lower: bool = True) -> None:
        self.data, offsets = string_parts(pc.utf8_lower(texts) if lower else texts)
        m = word_mask(self.data)
        edge = np.zeros(len(m) + 1, bool)
        edge[offsets] = True  # words end with their text
        before = np.concatenate(([False], m[:-1])) if len(m) else m
        after = np.concatenate((m[1:], [False])) if len(m) else m
        self.start = np.flatnonzero(m & (~before | edge[:-1]))
        self.end = np.flatnonzero(m & (~after | edge[1:])) + 1
        self.row = np.searchsorted(self.start, offsets)
        self.offsets = offsets

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))

    @property
    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans of ``data``, as ``hash`` gives them for words."""
        p = prefix_hash(_BYTE[self.data])
        return mix((p[end] - p[start]) * powers(len(p))[1][start], 1)

    def strings(self, which: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode() for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of single words, as ``Words`` gives them."""
    out = np.zeros(len(words), U)
    for k, w in enumerate(words):
        found = Words(pa.array([w]))
        out[k] = found.hash[0] if len(found.start) == 1 else U(0)
    return out


def inside(row: np.ndarray, n: int, width: int) -> np.ndarray:
    """Starts of runs of ``width`` words, of ``n`` in all, that lie in one text."""
    count = max(0, n - width + 1)
    ok = np.zeros(count + 1, np.int32)
    a, b = row[:-1], np.maximum(row[1:] - width + 1, row[:-1])
    np.add.at(ok, np.minimum(a, count), 1)
    np.add.at(ok, np.minimum(b, count), -1)
    return np.flatnonzero(np.cumsum(ok)[:count] > 0)


# ---------------------------------------------------------------- bitmaps of bounded size


def bits_for(n: int, per_key: int = 16, least: int = 20, most: int = 28) -> int:
    """log2 of the bits of a bitmap for n keys: bounded, so that it can be broadcast whatever the data; fuller bitmaps let more through."""
    return min(most, max(least, (max(n, 1) * per_key - 1).bit_length()))


def bitmap(keys: DataFrame, column: str, log2: int) -> np.ndarray:
    """Two bits for each 64-bit key, set by the executors and merged by Spark; 2**(log2 - 3) bytes come to the driver."""
    c = F.col(column)
    at = keys.select(F.explode(F.array(*(F.shiftrightunsigned(c, 64 - log2 - s).bitwiseAND(F.lit((1 << log2) - 1)) + 1 for s in (0, 29)))).alias("b"))
    rows = at.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).toArrow()
    out = np.zeros((1 << log2) // 8, np.uint8)
    for k, m in zip(rows.column("k").to_pylist(), rows.column("m").to_pylist()):
        at0 = (k - 1) * 4096
        out[at0 : at0 + 4096] = np.frombuffer(m, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray, log2: int) -> np.ndarray:
    """Which keys may be in the bitmap; no key that is in it is missed."""
    ok = np.ones(len(keys), bool)
    for s in (0, 29):
        b = (keys >> U(64 - log2 - s)) & U((1 << log2) - 1)
        ok &= (bits[b >> U(3)] >> (b & U(7)).astype(np.uint8)) & 1 > 0
    return ok
