"""Repeated byte strings by run-length compressed Burrows-Wheeler indexes.

Every window of ``length`` bytes has an anchor, the leftmost least of its hashed 64-byte strings, which its content
alone decides; equal windows have equal anchors at equal places. A stretch of windows with one anchor is a piece. Only
pieces whose anchor occurs again are looked at: equal pieces count as repeated whole; different pieces around one anchor
go, once each, to the bucket of the anchor, where one index is built over them. There the BWT is cut into runs. Where a
run starts or ends, the match of the suffix with its neighbour in suffix order is measured (the sampled run ends); within
runs it is one byte shorter than for the suffix that begins a byte earlier. So a pass over the text streams the matching
statistics of every place against all others, and marks the matches of ``length`` bytes or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import as_bytes, checkpointed, discard, extended, map_batches, record

LENGTH = 400
GRAM = 64
#: Bytes of text that are hashed at a time, and of pieces in one index.
CHUNK, INDEX_BYTES = 1 << 17, 1 << 21
#: An anchor with more different pieces than fit one task is dealt out by the hashes of its windows instead.
ANCHOR_PIECES = 2_000
PLACE = np.uint64((1 << 24) - 1)


def _grams(a: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the ``GRAM`` bytes from each place."""
    h, size, base = a.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base & 0xFFFFFFFFFFFFFFFF, size * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def cut(data: bytes, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the texts that begin at ``starts`` of the joined ``data``: text, first window, last window, anchor."""
    a = np.frombuffer(data, np.uint8)
    none = np.zeros(0, np.int64)
    if len(a) < length:
        return none, none, none, none
    hashes = _grams(a)
    keyed = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    place = (_least(keyed, length - GRAM + 1) & PLACE).astype(np.int64)  # of the anchor of each window
    ends = np.append(starts[1:], len(a))
    ok = np.zeros(len(place) + 1, np.int32)
    real = ends - starts >= length
    ok[starts[real]] += 1
    ok[np.minimum(ends[real] - length + 1, len(place))] -= 1
    at = np.flatnonzero(np.cumsum(ok[:-1]))
    if not len(at):
        return none, none, none, none
    new = np.concatenate(([True], (np.diff(place[at]) != 0) | (np.diff(at) != 1)))
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    return np.searchsorted(starts, first, "right") - 1, first, last, hashes[place[first]].view(np.int64)


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of about ``CHUNK`` bytes, where each begins, its number and its offset; long texts overlap."""
    held, size, number, offset = [], 0, [], []
    for i, x in enumerate(texts):
        if len(x) < length:
            continue
        for at in range(0, max(1, len(x) - length + 1), 1 << 23):
            part = x[at : at + (1 << 23) + length - 1] if len(x) > 1 << 23 else x
            held.append(part)
            number.append(i)
            offset.append(at)
            size += len(part)
            if size >= CHUNK:
                yield b"".join(held), np.cumsum([0, *map(len, held[:-1])]), np.array(number), np.array(offset)
                held, size, number, offset = [], 0, [], []
    if held:
        yield b"".join(held), np.cumsum([0, *map(len, held[:-1])]), np.array(number), np.array(offset)


def find_pieces(rows: DataFrame, length: int) -> DataFrame:
    """``anchor, piece, row, start, size, times``: equal pieces that begin at consecutive bytes are one row."""
    from xxhash import xxh3_64_intdigest

    def run(batch: pa.RecordBatch) -> dict:
        ids, out = batch.column("row").to_numpy(), []
        for data, starts, number, offset in _chunks(as_bytes(batch.column("text")), length):
            text, first, last, anchor = cut(data, starts, length)
            if not len(text):
                continue
            ends = (last + length).tolist()
            piece = np.fromiter((xxh3_64_intdigest(data[s:e]) for s, e in zip(first.tolist(), ends, strict=True)), np.uint64, len(ends)).view(np.int64)
            begin = first - starts[text] + offset[text]
            new = np.concatenate(([True], (np.diff(piece) != 0) | (np.diff(anchor) != 0) | (np.diff(begin) != 1) | (np.diff(text) != 0)))
            times = np.diff(np.append(np.flatnonzero(new), len(new)))
            out.append((anchor[new], piece[new], ids[number[text[new]]], begin[new], (last - first + length)[new], times))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        return dict(zip(("anchor", "piece", "row", "start", "size", "times"), map(pa.array, columns), strict=True))

    return map_batches(rows, run, "anchor long, piece long, row long, start int, size int, times int")


class RunIndex:
    """Run-length compressed BWT of pieces, each with an end mark of its own."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(self.text)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        self.left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(n)  # bytes up to the piece's end
        order = self._sorted(int(self.sizes.max(initial=0)))
        before = np.where(order > 0, self.text[order - 1], 0).astype(np.int16)
        heads = np.isin(order, self.starts, assume_unique=True)
        before[heads] = -1  # the end mark before a piece equals no other
        change = np.concatenate(([True], (before[1:] != before[:-1]) | heads[1:]))
        self.run_starts = np.flatnonzero(change)
        self.letters = before[self.run_starts]
        ends = np.append(self.run_starts[1:], n) - 1
        #: Samples: the suffixes at the run starts with the one before each, at the run ends with the one after.
        self.at_start = (order[self.run_starts], order[self.run_starts - 1], self.run_starts > 0)
        self.at_end = (order[ends], order[np.minimum(ends + 1, n - 1)], ends < n - 1)

    def _sorted(self, longest: int) -> np.ndarray:
        """Suffix order by doubling; like suffixes up to their ends stand in the order of their pieces."""
        n, left = len(self.text), self.left
        padded = np.concatenate((self.text, np.zeros(8, np.uint8))).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(7):  # a byte counts one more, past the end nothing
            key = key * np.uint64(257) + np.where(left > i, padded[i : n + i] + np.uint64(1), np.uint64(0))
        order = np.argsort(key)
        size = 7
        while True:
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            steps = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            rank[order] = steps
            if size >= longest or steps[-1] == n - 1:
                return np.lexsort((np.arange(n), rank)) if steps[-1] != n - 1 else order
            follow = np.zeros(n, np.int64)
            go = np.flatnonzero(left > size)
            follow[go] = rank[go + size] + 1
            key = rank * (n + 1) + follow
            order = np.argsort(key)
            size *= 2

    def _common(self, a: np.ndarray, b: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Length of the match of two suffixes within their pieces."""
        most = np.where(valid, np.minimum(self.left[a], self.left[b]), 0)
        out = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(most > 0)
        padded = np.concatenate((self.text, np.zeros(64, np.uint8)))
        view = np.lib.stride_tricks.sliding_window_view(padded, 64)
        while len(open_):
            same = view[a[open_] + out[open_]] == view[b[open_] + out[open_]]
            run = np.where(same.all(1), 64, same.argmin(1))
            out[open_] = np.minimum(out[open_] + run, most[open_])
            open_ = open_[(run == 64) & (out[open_] < most[open_])]
        return out

    def matching(self) -> np.ndarray:
        """For each place the longest match that begins anywhere else: one stream for either neighbour."""
        n, best = len(self.text), np.zeros(len(self.text), np.int64)
        if not n:
            return best
        where = np.arange(n)
        for a, b, valid in (self.at_start, self.at_end):
            value = np.full(n, -1, np.int64)
            value[a] = self._common(a, b, valid)
            source = np.maximum.accumulate(np.where(value >= 0, where, 0))  # the last sample up to each place
            best = np.maximum(best, value[source] - (where - source))
        return best


def _ranges(flags: np.ndarray) -> list[list[int]]:
    """First and last place of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [[a, b - 1] for a, b in edges.reshape(-1, 2).tolist()]


def _marks(needed: DataFrame, length: int) -> DataFrame:
    """``anchor, piece, marks``: the ranges of windows in each piece that occur elsewhere, by an index for each bucket."""
    from pyspark.sql.pandas.types import to_arrow_schema

    size = needed.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(1, -(-size // INDEX_BYTES))
    schema = extended(needed.select("anchor", "piece"), marks="array<array<int>>")
    fields = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        data = table.column("data").to_pylist()
        index = RunIndex(data)
        hit = index.matching() >= length
        marks = [_ranges(hit[s : s + n]) for s, n in zip(index.starts.tolist(), index.sizes.tolist(), strict=True)]
        out = record({"anchor": table.column("anchor").combine_chunks(), "piece": table.column("piece").combine_chunks(), "marks": marks}, fields)
        return pa.Table.from_batches([out.filter(pa.array([bool(m) for m in marks], pa.bool_()))])

    return needed.withColumn("bucket", F.pmod("anchor", F.lit(buckets))).groupBy("bucket").applyInArrow(run, schema)


def _window_marks(needed: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many pieces for a task: equal windows meet by hash, partly summed before they move."""
    from xxhash import xxh3_64_intdigest

    def run(batch: pa.RecordBatch) -> dict:
        out = [(a, p, o, xxh3_64_intdigest(d[o : o + length]) - (1 << 63)) for a, p, d in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "data")), strict=True) for o in range(len(d) - length + 1)]
        return dict(zip(("anchor", "piece", "at", "window"), zip(*out, strict=True) if out else ([],) * 4, strict=True))

    windows = map_batches(needed, run, "anchor long, piece long, at int, window long")
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(twice, ["anchor", "window"]).groupBy("anchor", "piece").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: F.array(x, x)).alias("marks"))


def repeats(rows: DataFrame, length: int = LENGTH, anchor_pieces: int = ANCHOR_PIECES) -> DataFrame:
    """``row, ranges``: of rows ``row, text`` the byte ranges ``[start, end)`` under strings of ``length`` bytes that occur again.

    Ranges may overlap. Rows without any are left out; null texts have none.
    """
    found = find_pieces(rows, length)
    # as a table of its own: a join of two plain shuffles is one that Spark splits at hot anchors
    again = checkpointed(found.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"))
    shared = checkpointed(found.join(again, "anchor"))
    discard(again)
    distinct = checkpointed(shared.groupBy("anchor", "piece").agg(F.sum("times").alias("n"), F.min(F.struct("row", "start", "size")).alias("one")))
    different = distinct.groupBy("anchor").agg(F.count("*").alias("pieces")).where("pieces > 1")
    wanted = distinct.join(different, "anchor").select("anchor", "piece", "pieces", "one.*")

    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "piece", "pieces", "start", "size")).alias("w"))

    def fetch(batch: pa.RecordBatch) -> dict:
        out = [(w["anchor"], w["piece"], w["pieces"], x[w["start"] : w["start"] + w["size"]]) for x, ws in zip(as_bytes(batch.column("text")), batch.column("w").to_pylist(), strict=True) for w in ws]
        return dict(zip(("anchor", "piece", "pieces", "data"), zip(*out, strict=True) if out else ([],) * 4, strict=True))

    needed = checkpointed(map_batches(rows.join(by_row, "row").select("text", "w"), fetch, "anchor long, piece long, pieces long, data binary"))
    few, many = needed.where(F.col("pieces") <= anchor_pieces), needed.where(F.col("pieces") > anchor_pieces)
    part = _marks(few, length).unionAll(_window_marks(many, length))
    whole = distinct.where("n > 1").select("anchor", "piece", F.lit(None).cast("array<array<int>>").alias("marks"))
    once = distinct.where("n = 1").select("anchor", "piece")
    marks = whole.unionAll(part.join(once, ["anchor", "piece"]).select("anchor", "piece", "marks"))
    spans = F.when(F.col("marks").isNull(), F.array(F.array(F.col("start"), F.col("start") + F.col("size") + F.col("times") - 1))).otherwise(F.transform("marks", lambda m: F.array(F.col("start") + m[0], F.col("start") + m[1] + length)))
    return shared.join(marks, ["anchor", "piece"]).select("row", spans.alias("s")).groupBy("row").agg(F.flatten(F.collect_list("s")).alias("ranges"))


def merge(ranges: list[list[int]]) -> list[list[int]]:
    """Maximal runs of the bytes under the ranges."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor_pieces: int = ANCHOR_PIECES) -> DataFrame:
    """``key, n_bytes, spans, kept`` for each row: the removed byte runs and the bytes that stay.

    A byte goes if a string of ``length`` bytes over it begins anywhere else, in this text or another. Strings are judged
    on the input, as UTF-8, and end with their text. A null text is empty. Repeated rows repeat all their strings; null
    keys and other columns have no influence. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    # numbered once and written: every later scan must see a text under the same number
    rows = checkpointed(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("text")))
    found = repeats(rows.select("row", "text"), length, anchor_pieces)
    schema = extended(df.select(key), n_bytes="long", spans="array<array<int>>", kept="binary")
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            spans = [merge(r or []) for r in batch.column("ranges").to_pylist()]
            kept = []
            for x, ranges in zip(texts, spans, strict=True):
                edges = [0, *(e for r in ranges for e in r), len(x)]
                kept.append(b"".join(x[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield record({key: batch.column("k"), "n_bytes": [len(x) for x in texts], "spans": spans, "kept": kept}, fields)

    return rows.join(found, "row", "left").select("k", "text", "ranges").mapInArrow(run, schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of ``dedup``'s rows and the SHA-256 of the bytes that stay."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


