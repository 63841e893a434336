"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, decoding by concatenation."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts in which a space touches other white space, or with rare white space, are split by the pattern as a whole.
IRREGULAR = r"  | \n| $|[\t\r\f\v\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CACHED = 200_000


def load(vocabulary: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece.

    The symbols are a doubly linked list; the queue holds (rank, place, lengths of both symbols) of each pair that can merge.
    The lowest rank merges first, the leftmost of equals; an entry whose symbols have changed since is stale and skipped."""
    n = len(piece)
    nxt, prv, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    get = ranks.get
    queue = [(r, i, 1, 1) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(queue)
    while queue:
        _, i, a, b = heappop(queue)
        j = i + a
        if size[i] != a or j >= n or size[j] != b:
            continue
        size[i], size[j] = a + b, 0
        k = nxt[j]
        nxt[i] = k
        if k < n:
            prv[k] = i
            if (r := get(piece[i : k + size[k]])) is not None:
                heappush(queue, (r, i, a + b, size[k]))
        h = prv[i]
        if h >= 0 and (r := get(piece[h:k])) is not None:
            heappush(queue, (r, h, size[h], a + b))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : i + size[i]]])
        i = nxt[i]
    return out


class Encoder:
    """Encodes strings; remembers the last pieces, at most CACHED of each kind."""

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = load(vocabulary)
        self.split = regex.compile(PATTERN).findall
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit integers side by side."""
        out: list[bytes] = []
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        known = self.pieces
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = known[p] = array("i", merge(p.encode(), self.ranks)).tobytes()
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def text(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def chunk(self, text: str) -> bytes:
        """A run of text without space but perhaps at its start; they recur."""
        ids = self.chunks.get(text)
        if ids is None:
            if len(self.chunks) > CACHED:
                self.chunks.clear()
            ids = self.chunks[text] = self.packed(text)
        return ids

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin.  Each distinct chunk between spaces is encoded once; numpy
        copies its ids to wherever it occurs."""
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        parts = pc.split_pattern(plain, " ")
        offsets = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, 4 * parts.offset).astype(np.int64)
        coded = parts.values.dictionary_encode()
        code = coded.indices.to_numpy()
        names = coded.dictionary.to_pylist()
        first = np.zeros(len(code), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        ids = [self.chunk(" " + x) for x in names]  # with the space before
        firsts, where = np.unique(code[first], return_inverse=True)
        ids += [self.chunk(names[i]) for i in firsts.tolist()]
        code = code.copy()
        code[first] = len(names) + where
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        for i in np.flatnonzero(odd).tolist():  # such a text has one empty chunk so far
            code[offsets[i]] = len(ids)
            ids.append(self.packed(texts[i].as_py()))
        flat, begin = _flatten(ids)
        size = np.diff(begin)[code]
        starts = np.concatenate(([0], np.cumsum(size)))
        out = flat[np.repeat(begin[code] - starts[:-1], size) + np.arange(starts[-1])]
        rows = np.zeros(len(texts) + 1, np.int64)
        np.add.at(rows, owner + 1, size)
        return out, np.cumsum(rows)


def _flatten(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    begin = np.concatenate(([0], np.cumsum([len(x) for x in packed]))).astype(np.int64) // 4
    return np.frombuffer(b"".join(packed), np.int32), begin


class Decoder:
    def __init__(self, vocabulary: bytes) -> None:
        ranks = load(vocabulary)
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in by_id]))).astype(np.int64)

    def batch(self, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
        """Texts of the ids ``rows[i]`` to ``rows[i + 1]``: their tokens' bytes side by side."""
        size = np.diff(self.begin)[ids]
        starts = np.concatenate(([0], np.cumsum(size)))
        data = self.bytes[np.repeat(self.begin[ids] - starts[:-1], size) + np.arange(starts[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(rows) - 1, [None, pa.py_buffer(starts[rows]), pa.py_buffer(data)]).cast(pa.string())


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, with_text: bool = False) -> DataFrame:
    """``doc_id, n_tokens, token_ids, exact`` of each row, and with ``with_text`` the decoded ``text``.

    ``exact`` says whether decoding gave the text back.  An empty or null text has no tokens (and decodes to '' or null).
    Special tokens' strings are ordinary text, texts of any length are encoded as a whole, an empty table gives no rows.  Ids may be null or
    repeated; other columns are ignored, whatever their names.  ``vocabulary`` is read
    by the driver and broadcast: its size doesn't depend on the data."""
    raw = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(raw.value), Decoder(raw.value)
        for batch, texts in text_slices(batches, "text"):
            ids, rows = encoder.batch(texts)
            back = decoder.batch(ids, rows)
            lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids))
            columns = [batch.column(0), pa.array(np.diff(rows)), lists, pc.equal(back, texts)]
            if with_text:
                columns.append(pc.if_else(batch.column(1).is_null(), pa.scalar(None, pa.string()), back))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "token_ids", "exact", "text"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, exact boolean" + ", text string" * with_text)


def encode_text(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids of one text."""
    return Encoder(Path(vocabulary).read_bytes()).text(text)


__all__ = ["Decoder", "Encoder", "encode_text", "load", "merge", "round_trip"]
