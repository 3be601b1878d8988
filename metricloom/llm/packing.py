"""Packed token matrices: best-fit-decreasing packing with a segment tree over the capacities left.

Documents become token ids and an end mark; one that is longer than a row is cut into whole rows and a rest, so nothing
is lost. Pieces of a bounded pool are packed longest first, each into the row that it fills best. A row of the matrix
comes with the cumulative lengths of its segments, with positions that start at 0 in each, and with where each segment
comes from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import extended, record

CAPACITY = 2048
#: Tokens that are packed together: thousands of rows, so what stays empty at its end hardly counts.
POOL_TOKENS = 6_000_000


class Capacities:
    """A segment tree over 0 to ``most``: which amounts of room are left in some open row."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.used = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at and not self.used[at]:
            self.used[at] = 1
            at >>= 1

    def best(self, need: int) -> int:
        """The least room of at least ``need``, or -1."""
        at = need + self.size
        if self.used[at]:
            return need
        while at > 1:
            if not at & 1 and self.used[at + 1]:  # a right neighbour below the same parent
                at += 1
                while at < self.size:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1

    def take(self, room: int) -> int:
        row = self.rows[room].pop()
        at = room + self.size
        if not self.rows[room]:
            self.used[at] = 0
            while at > 1 and not self.used[at ^ 1]:
                at >>= 1
                self.used[at] = 0
        return row


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces in each row, by best fit, longest first; equal ones keep their order."""
    rooms, rows = Capacities(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = rooms.best(sizes[i])
        if room < 0:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = rooms.take(room)
        rows[row].append(i)
        if room > sizes[i]:
            rooms.add(room - sizes[i], row)
    return rows


@lru_cache(maxsize=2)
def rank_file_encoder(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the ranks in a file, of a fixed size and installed on every machine."""
    import tiktoken

    from metricloom.llm.bpe import load_ranks

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return lambda text: np.array(encoding.encode_ordinary(text), np.uint32)


def packed(df: DataFrame, path: str, pattern: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row for each row of the matrix.

    ``pack_id``; ``n_tokens``; ``ids`` and ``position_ids``, little-endian 16-bit (32-bit from an ``end_id`` of 65,536
    on), ``capacity`` of each, unused ids ``end_id`` and their positions 0; ``cu_seqlens``, from 0 to ``n_tokens``;
    ``segments``: key, row number, first token within the document and length of each. Every document ends with
    ``end_id``, so a null or empty text is a segment of that alone. Repeated rows have row numbers of their own. An empty
    table gives no rows; other columns are not read.
    """
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = df.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    kind = docs.schema["k"].dataType.simpleString()
    schema = extended(docs.select(), pack_id="bigint", n_tokens="int", ids="binary", position_ids="binary", cu_seqlens="array<int>", segments=f"array<struct<key: {kind}, row: bigint, start: bigint, length: int>>")
    fields = to_arrow_schema(schema)
    width = np.dtype("<u2" if end_id < 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces, held, made = rank_file_encoder(path, pattern), [], 0, TaskContext.get().partitionId() << 33

        def flush() -> pa.RecordBatch:
            nonlocal made
            rows = pack([len(p[3]) for p in pieces], capacity)
            ids, positions = np.full((len(rows), capacity), end_id, width), np.zeros((len(rows), capacity), width)
            lengths, segments = [], []
            for r, members in enumerate(rows):
                ends = np.cumsum([0, *(len(pieces[i][3]) for i in members)])
                ids[r, : ends[-1]] = np.concatenate([pieces[i][3] for i in members])
                positions[r, : ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
                lengths.append(ends)
                segments.append([{"key": pieces[i][0], "row": pieces[i][1], "start": pieces[i][2], "length": len(pieces[i][3])} for i in members])
            out = {"pack_id": list(range(made, made + len(rows))), "n_tokens": [int(e[-1]) for e in lengths], "ids": [x.tobytes() for x in ids], "position_ids": [x.tobytes() for x in positions], "cu_seqlens": lengths, "segments": segments}
            made += len(rows)
            return record(out, fields)

        for batch in batches:
            for k, row, x in zip(*(batch.column(c).to_pylist() for c in ("k", "row", "text")), strict=True):
                ids = np.append(encode(x or ""), np.uint32(end_id)).astype(width)
                for at in range(0, len(ids), capacity):
                    pieces.append((k, row, at, ids[at : at + capacity]))
                held += len(ids)
                if held >= pool_tokens:
                    yield flush()
                    pieces, held = [], 0
        if pieces:
            yield flush()

    return docs.mapInArrow(run, schema)


def unpacked(rows: DataFrame, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``key, row, ids``: the token ids of each document, without its end mark, from a matrix."""
    width = 2 if end_id < 1 << 16 else 4
    parts = rows.select("ids", F.posexplode(F.arrays_zip("segments", F.slice("cu_seqlens", 1, F.size("segments")).alias("at"))).alias("i", "z")).select(
        "z.segments.*", F.expr(f"substring(ids, z.at * {width} + 1, z.segments.length * {width})").alias("part")
    )
    whole = parts.groupBy("row").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))

    @F.pandas_udf("array<int>")
    def joined(parts):
        import pandas as pd

        return pd.Series([np.frombuffer(b"".join(p["part"] for p in x), "<u2" if width == 2 else "<u4")[:-1].astype(np.int32) for x in parts])

    return whole.select("key", "row", joined("parts").alias("ids"))


def write(rows: DataFrame, path: str) -> None:
    """The matrix as Parquet: fixed-width binary rows beside their lengths and sources."""
    rows.write.mode("errorifexists").parquet(path)


def matrix(rows: list, name: str, end_id: int) -> np.ndarray:
    """Collected rows of a matrix as one array."""
    return np.frombuffer(b"".join(r[name] for r in rows), "<u2" if end_id < 1 << 16 else "<u4").reshape(len(rows), -1)
