"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Many pre-tokens are merged together: their bytes stand in one linked list with breaks between the pre-tokens. Each
mergeable pair waits in the bucket of its rank. A bitmap marks the ranks with entries, one word for 512 of them, and a
summary word marks the words in use, so find-first-set gives the lowest rank. An entry whose pair has changed since it
was put in is stale and skipped. All positions of a rank merge at once, leftmost first within a pre-token.

Merging at once equals merging one by one unless a merge opens a pair of lower rank than its own; a pre-token where that
happens is encoded again by itself, one merge at a time, with the same queue.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import record, slices_of

SHIFT = 9


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class RankQueue:
    """Buckets by rank under two levels of bitmap words; ``put`` adds to a bucket, as to a list or to a heap."""

    def __init__(self, put=list.append) -> None:
        self.summary, self.words, self.buckets, self.put = 0, {}, {}, put

    def push(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [entry]
            word = rank >> SHIFT
            self.words[word] = self.words.get(word, 0) | 1 << (rank & (1 << SHIFT) - 1)
            self.summary |= 1 << word
        else:
            self.put(bucket, entry)

    def first(self) -> int:
        """The lowest rank with entries, or -1."""
        if not self.summary:
            return -1
        word = (self.summary & -self.summary).bit_length() - 1
        bits = self.words[word]
        return (word << SHIFT) + (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list:
        word = rank >> SHIFT
        self.words[word] &= ~(1 << (rank & (1 << SHIFT) - 1))
        if not self.words[word]:
            self.summary &= ~(1 << word)
        return self.buckets.pop(rank)


class Numbers(dict):
    """A number for each pre-token, by first appearance."""

    def __missing__(self, x: str) -> int:
        n = self[x] = len(self)
        return n


class BytePairs:
    """Encoder and decoder for one table of ranks; pre-tokens are the matches of ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept_entries: int = 100_000) -> None:
        import regex

        self.ranks, self.limit = ranks, kept_entries
        self.split = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(size)]
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(2**62))
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.numbers, self.ids = Numbers(), []

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where there is no merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_one(self, data: bytes) -> tuple[int, ...]:
        """One merge at a time, lowest rank first, then leftmost."""
        if data in self.ranks:
            return (self.ranks[data],)
        token, n, pairs, queue = self.single[np.frombuffer(data, np.uint8)].tolist(), len(data), self.pairs, RankQueue(heapq.heappush)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(at: int) -> None:
            if at >= 0 and after[at] < n and (rank := pairs.get(token[at] << 32 | token[after[at]])) is not None:
                queue.push(rank, at)

        for at in range(n - 1):
            offer(at)
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            at = heapq.heappop(bucket)
            if not bucket:
                queue.take(rank)
            if token[at] < 0 or after[at] >= n or pairs.get(token[at] << 32 | token[after[at]]) != rank:
                continue
            gone = after[at]
            token[at], token[gone], after[at] = rank, -1, after[gone]
            if after[gone] < n:
                before[after[gone]] = at
            offer(at)
            offer(before[at])
        return tuple(t for t in token if t >= 0)

    def encode_many(self, texts: list[bytes]) -> list[tuple[int, ...]]:
        """All of them in one queue."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1]) if len(ends) else 0
        token = self.single[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)] if texts else np.zeros(0, np.int32)
        token[ends - 1] = -2  # a break joins nothing
        word = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        queue, later, again = RankQueue(), [], set()

        def deal(at: np.ndarray, rank: np.ndarray) -> None:
            """Put entries into the buckets of their ranks."""
            if len(at):
                order = np.lexsort((at, rank))
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(np.diff(rank)) + 1
                for part, r in zip(np.split(at, cuts), rank[np.concatenate(([0], cuts))].tolist(), strict=True):
                    queue.push(r, part)

        first = np.flatnonzero((token[:-1] >= 0) & (token[1:] >= 0))
        found = self.rank_of(token[first], token[first + 1])
        deal(first[found >= 0], found[found >= 0])
        front = -1
        while True:
            rank = queue.first()
            if later and (rank < 0 or rank >> SHIFT > front):
                at, ranks = (np.concatenate(x) for x in zip(*later, strict=True))
                later = []
                deal(at, ranks)
                rank = queue.first()
            if rank < 0:
                break
            front = rank >> SHIFT
            entries = queue.take(rank)
            at = entries[0] if len(entries) == 1 else np.unique(np.concatenate(entries))
            left, follow = token[at], after[at]
            live = left >= 0
            right = token[np.minimum(follow, n - 1)]
            live &= right >= 0
            if not live.all():
                at, follow, left, right = at[live], follow[live], left[live], right[live]
            if not len(at):
                continue
            live = self.rank_of(left, right) == rank
            if not live.all():
                at, follow = at[live], follow[live]
                if not len(at):
                    continue
            if len(at) > 1 and (joined := at[1:] == follow[:-1]).any():  # overlapping pairs: every other one of a run
                start = np.concatenate(([True], ~joined))
                where = np.arange(len(at))
                keep = (where - np.maximum.accumulate(np.where(start, where, 0))) % 2 == 0
                at, follow = at[keep], follow[keep]
            beyond = after[follow]
            token[at], token[follow] = rank, -1
            after[at] = beyond
            before[beyond[beyond < n]] = at[beyond < n]
            prior = before[at]
            prior = prior[prior >= 0]
            new = np.unique(np.concatenate((prior, at)))
            a, b = token[new], token[np.minimum(after[new], n - 1)]
            ok = (a >= 0) & (b >= 0)
            new, found = new[ok], self.rank_of(a[ok], b[ok])
            if len(lower := new[(found >= 0) & (found < rank)]):
                again.update(word[lower].tolist())
            ok = found >= 0
            new, found = new[ok], found[ok]
            if len(new):
                here = found >> SHIFT <= front
                if here.any():
                    deal(new[here], found[here])
                    new, found = new[~here], found[~here]
                if len(new):
                    later.append((new, found))
        kept = token >= 0
        ids, owner = token[kept].tolist(), word[kept]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        out = [tuple(ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
        for i in again:
            out[i] = self.encode_one(texts[i])
        return out

    def encode_texts(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; the pre-tokens that were not seen before are merged together.

        Texts stand as numbers of pre-tokens meanwhile, so a pre-token is held once however often it occurs.
        """
        if len(self.numbers) > self.limit:
            self.numbers, self.ids = Numbers(), []
        known = self.numbers.__getitem__
        found = [np.fromiter(map(known, self.split(text)), np.int32) for text in texts]
        rest = []
        for x in islice(self.numbers, len(self.ids), None):
            data = x.encode()
            rank = self.ranks.get(data)
            if rank is None:
                rest.append((len(self.ids), data))
            self.ids.append((rank,))
        for (at, _), ids in zip(rest, self.encode_many([d for _, d in rest]), strict=True):
            self.ids[at] = ids
        for numbers in found:
            yield list(chain.from_iterable(map(self.ids.__getitem__, numbers.tolist())))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairs:
    """One for each worker: the rank file, of a fixed size, is installed on every machine."""
    return BytePairs(load_ranks(path), pattern)


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``limit`` characters of text, or one row."""
    for batch in slices_of(batches, 2_000):
        texts = [x or "" for x in batch.column(text).to_pylist()]
        start, held = 0, 0
        for i, x in enumerate(texts):
            if held and held + len(x) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += len(x)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", block_chars: int = 7_000_000) -> DataFrame:
    """All columns and ``ids``, the token ids of each text, as ``array<int>``; a column of that name is replaced.

    A null text has no ids, as the empty one. Rows and repeated rows stay as they are; an empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = df.drop(ids)
    schema = kept.withColumn(ids, F.lit(None).cast("array<int>")).schema
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = encoder(path, pattern)
        for batch, texts in blocks(batches, text, block_chars):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pairs.encode_texts(texts), fields.field(ids).type)], schema=pa.schema([*batch.schema, fields.field(ids)]))

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and ``out``, the bytes of the ids; null ids give no bytes, an unknown id raises an error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = df.drop(out)
    schema = kept.withColumn(out, F.lit(None).cast("binary")).schema
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pairs.decode(x or ()) for x in batch.column(ids).to_pylist()], fields.field(out).type)], schema=pa.schema([*batch.schema, fields.field(out)]))

    return kept.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", block_chars: int = 7_000_000) -> DataFrame:
    """Encode each text, decode its ids, and return ``key, n_tokens, ids_sha256, decoded_sha256``: ids leave no worker.

    One row for each row of the input, null keys and repeated rows included; a null text counts as empty. Other columns
    of the input are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = df.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = encoder(path, pattern)
        for batch, texts in blocks(batches, text, block_chars):
            n, a, b = [], [], []
            for ids in pairs.encode_texts(texts):
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(pairs.decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(pairs.decode(ids)).hexdigest())
            yield record({key: batch.column(key), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}, fields)

    return df.select(key, text).mapInArrow(run, schema)
