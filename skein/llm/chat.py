"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_parts

BEGIN, AFTER_ROLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
CHUNK = 32 << 20


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies segment i of ``data``, ``offsets[i]`` to ``offsets[i + 1]``, to ``out[at[i]:]``, all in one indexed store."""
    length = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], length) + np.arange(len(data))] = data


def assemble(counts: np.ndarray, roles: pa.Array, texts: pa.Array, begin: bytes, after_role: bytes, end: bytes) -> pa.Array:
    """Conversation k has the next ``counts[k]`` turns: segment lengths, cumulative offsets, then one buffer filled in place."""
    (role, role_at), (text, text_at) = string_parts(roles), string_parts(texts)
    fixed = [np.frombuffer(x, np.uint8) for x in (begin, after_role, end)]
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = (len(x) for x in fixed)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    offsets = np.concatenate(([0], np.cumsum(lengths.ravel())))
    out = np.empty(int(offsets[-1]), np.uint8)
    at = offsets[:-1].reshape(n, 5)
    for column, data in zip((0, 2, 4), fixed):
        out[at[:, column, None] + np.arange(len(data))] = data
    scatter(out, at[:, 1], role, role_at)
    scatter(out, at[:, 3], text, text_at)
    ends = offsets[5 * np.concatenate(([0], np.cumsum(counts)))]
    return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])


def format_chats(turns: DataFrame, begin: str = BEGIN, after_role: str = AFTER_ROLE, end: str = END) -> DataFrame:
    """One row a conversation: ``conv_id, n_turns, text``, its turns in order of (turn, role, text), nulls first.

    Each turn is begin + role + after_role + text + end, verbatim.  A null role reads 'unknown', a null text ''.  Repeated rows
    are repeated turns.  Rows with a null conv_id are left out; an empty table gives no rows; texts may be of any length; other columns are
    ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            size = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            values = lists.flatten()
            weigh = np.cumsum(pc.add(pc.fill_null(pc.binary_length(values.field("text")), 0), 64).to_numpy(zero_copy_only=False)) if len(values) else size
            total, k = weigh[size - 1], 0
            while k < len(ids):
                to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + CHUNK, "right")))
                a, b = int(size[k - 1]) if k else 0, int(size[to - 1])
                part = values.slice(a, b - a)
                role = pc.fill_null(pc.struct_field(part, "role"), "unknown")
                text = pc.fill_null(pc.struct_field(part, "text"), "")
                n = np.diff(np.concatenate(([a], size[k:to])))
                made = assemble(n, pa.concat_arrays([role]), pa.concat_arrays([text]), begin.encode(), after_role.encode(), end.encode())
                yield pa.RecordBatch.from_arrays([ids.slice(k, to - k), pa.array(n, pa.int64()), made.cast(pa.string())], names=["conv_id", "n_turns", "text"])
                k = to

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    grouped = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.mapInArrow(run, "conv_id long, n_turns long, text string")
