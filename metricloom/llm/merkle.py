"""Document fingerprints by a Merkle tree over paragraphs and sections.

A section ends at an empty line, a paragraph at a line end. The leaves of the tree are pieces of a paragraph, cut by
content, about sixteen bytes each. A paragraph's digest covers the digests of its leaves, a section's digest those of its
paragraphs, the root's those of the sections: equal roots tell equal texts, and where two trees differ, the branches that
differ locate the edit. The least leaf digests go with the root into the fingerprint: two fingerprints tell by them how
many leaves their trees share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from metricloom.llm.common import as_bytes, extended, map_batches, record

SKETCH = 128
#: One place in so many ends a piece.
PIECE = 16


def _sha(parts: list[bytes], kind: bytes) -> bytes:
    return hashlib.sha256(kind + b"".join(parts)).digest()


@dataclass
class Tree:
    """Digests by level, and the byte range of each paragraph."""

    root: bytes
    sections: list[bytes]
    paragraphs: list[list[bytes]]
    ranges: list[list[tuple[int, int]]]
    leaves: list[bytes]


def leaf_bounds(data: bytes) -> tuple[list[int], list[int], list[int]]:
    """Where leaves start and end, and how many line ends stand before each.

    A leaf ends where the four bytes before, all of one paragraph, say so, and with its paragraph; so a paragraph has the
    same leaves wherever it stands. Line ends are in no leaf.
    """
    if not data:
        return [], [], []
    a = np.frombuffer(data, np.uint8)
    line = a == 10
    cut = line.copy()
    cut[:-1] |= line[1:]
    if len(a) >= 4:
        wide = a.astype(np.uint32)
        mixed = (wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)) * np.uint32(2654435761)
        here = (mixed >> np.uint32(16)) % np.uint32(PIECE) == 0
        cut[3:] |= here & ~(line[:-3] | line[1:-2] | line[2:-1] | line[3:])
    cut[-1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate(([0], ends[:-1]))
    held = ~line[starts]
    before = np.cumsum(line)[starts]
    return starts[held].tolist(), ends[held].tolist(), before[held].tolist()


def tree(data: bytes) -> Tree:
    sha = hashlib.sha256
    starts, ends, before = leaf_bounds(data)
    leaves = [sha(data[s:e]).digest() for s, e in zip(starts, ends, strict=True)]
    first = np.searchsorted(before, np.arange(data.count(b"\n") + 2)).tolist()  # of each paragraph, its first leaf
    paragraphs, ranges, at, number = [], [], 0, 0
    for section in data.split(b"\n\n"):
        digests, places = [], []
        for paragraph in section.split(b"\n"):
            digests.append(_sha(leaves[first[number] : first[number + 1]], b"p"))
            places.append((at, at + len(paragraph)))
            at += len(paragraph) + 1
            number += 1
        paragraphs.append(digests)
        ranges.append(places)
        at += 1
        number += 1
    sections = [_sha(d, b"s") for d in paragraphs]
    return Tree(_sha(sections, b"r"), sections, paragraphs, ranges, leaves)


def _differ(a: list[bytes], b: list[bytes]) -> tuple[int, int, int]:
    """Like nodes at the start, and where the like nodes at the end begin in ``a`` and in ``b``."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    return first, len(a) - last, len(b) - last


def edited_range(a: Tree, b: Tree) -> tuple[int, int] | None:
    """Byte range of ``a``'s paragraphs, down the branches that differ, outside which it equals ``b``; None if equal."""
    if a.root == b.root:
        return None
    first, end, other = _differ(a.sections, b.sections)
    if end - first == 1 and other - first == 1:
        k = first
        i, j, _ = _differ(a.paragraphs[k], b.paragraphs[k])
        places = a.ranges[k]
        return (places[i][0] if i < len(places) else places[-1][1], places[max(i, j - 1)][1] if i < len(places) and j > i else places[min(i, len(places) - 1)][0])
    flat = [r for places in a.ranges[first:end] for r in places]
    if flat:
        return flat[0][0], flat[-1][1]
    at = a.ranges[first][0][0] if first < len(a.ranges) else a.ranges[-1][-1][1]
    return at, at


class Print:
    """A fingerprint: the root in hex, a colon, and the beginnings of the least leaf digests in base64."""

    __slots__ = ("root", "least", "tree")

    def __init__(self, data: bytes) -> None:
        self.tree = tree(data)
        self.root = self.tree.root.hex()
        own = np.unique(np.frombuffer(b"".join(self.tree.leaves), ">u8")[::4])[:SKETCH]
        self.least = np.unique(own >> np.uint64(32)).astype(">u4")

    def __str__(self) -> str:
        return f"{self.root}:{base64.b64encode(self.least.tobytes()).decode()}"


def likeness(root_a: str, a: np.ndarray, root_b: str, b: np.ndarray) -> float:
    """Share of leaves in common (twice the common ones over all), estimated from the least digests; 1 for equal roots."""
    if root_a == root_b:
        return 1.0
    union = np.union1d(a, b)[:SKETCH]
    if not len(union):
        return 0.0
    both = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    jaccard = both.sum() / len(union)
    return float(2 * jaccard / (1 + jaccard))


def parse(fingerprint: str) -> tuple[str, np.ndarray]:
    root, _, least = fingerprint.partition(":")
    return root, np.frombuffer(base64.b64decode(least), ">u4")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, root, fingerprint, n_sections, n_paragraphs`` for each row; a null text counts as empty.

    Repeated rows and null keys stay; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        prints = [Print(x) for x in as_bytes(batch.column(text))]
        return {
            key: batch.column(key),
            "root": [p.root for p in prints],
            "fingerprint": [str(p) for p in prints],
            "n_sections": [len(p.tree.sections) for p in prints],
            "n_paragraphs": [sum(map(len, p.tree.paragraphs)) for p in prints],
        }

    return map_batches(df.select(key, text), run, f"`{key}` {kind}, root string, fingerprint string, n_sections int, n_paragraphs int")


def edits(df: DataFrame, before: str, after: str, key: str = "doc_id") -> DataFrame:
    """``key, equal, start, end, near``: the byte range of ``before`` that the differing branches locate; nulls count as empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        pairs = [(Print(a), Print(b)) for a, b in zip(as_bytes(batch.column(before)), as_bytes(batch.column(after)), strict=True)]
        places = [edited_range(a.tree, b.tree) or (None, None) for a, b in pairs]
        return {key: batch.column(key), "equal": [a.root == b.root for a, b in pairs], "start": [p[0] for p in places], "end": [p[1] for p in places], "near": [likeness(a.root, a.least, b.root, b.least) for a, b in pairs]}

    return map_batches(df.select(key, before, after), run, f"`{key}` {kind}, equal boolean, start long, end long, near double")


def beside_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against itself with its second half replaced by the beginning of the next text, and against that text.

    The next document has the next lower key, then, among equal keys, the next MD5; null keys come last, and after the
    last comes the first. Rows are dealt out by ranges of the key, each range sorted in one task; the first row of every
    range also goes to the range before it, so each text moves once. The ranges' first keys, one for each range, are all
    that is collected. Keys are numbers; equal keys stay in one range. A null text counts as empty; an empty table gives
    no rows.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[key].dataType, NumericType):
        raise ValueError(f"the key {key} is no number")
    docs = df.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges)), reverse=True)
    part = F.when(F.col("k").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(F.lit(bounds).cast("array<double>"), lambda b: b > F.col("k").cast("double"))) if bounds else F.lit(0))
    dealt = docs.withColumn("part", part.cast("int")).withColumn("m", F.md5("t"))
    # the order within a range: higher keys first, then lower MD5s; a decimal also holds the least long's opposite
    down = -(F.col("k").cast("decimal(38,0)") if isinstance(df.schema[key].dataType, IntegralType) else F.col("k"))
    tops = dealt.groupBy("part").agg(F.min_by(F.struct("k", "m"), F.struct(down.alias("k"), "m")).alias("top")).orderBy("part").collect()
    order = [r.part for r in tops]
    back = [(r.top.k, r.top.m, order[i - 1]) for i, r in enumerate(tops)]
    kind = docs.schema["k"].dataType.simpleString()
    firsts = spark.createDataFrame(back, f"k {kind}, m string, before int")  # one row for each range
    doubled = dealt.join(F.broadcast(firsts), dealt.k.eqNullSafe(firsts.k) & (dealt.m == firsts.m), "left").select(dealt.k, "t", dealt.m, F.expr("inline(array_compact(array(struct(part, 0 as tail), case when before is not null then struct(before as part, 1 as tail) end)))"))
    placed = doubled.repartition(ranges, "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("k"), "m").select("k", "t", "part", "tail")

    schema = extended(df.select(key), n_chars="long", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double", edit_start="long", edit_end="long")
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)

    def pair(x: str, own: Print, y: str, other: Print) -> list:
        half = len(x) // 2
        data = (x[: len(x) - half] + y[:half]).encode()
        new = Print(data)
        place = edited_range(own.tree, new.tree) or (None, None)
        return [len(x), hashlib.sha256(data).hexdigest(), str(own), str(new), likeness(own.root, own.least, new.root, new.least), likeness(own.root, own.least, other.root, other.least), *place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, text, fingerprint and range of the row that waits for its next one
        for batch in batches:
            keys, out = [], []
            for i, (x, p, tail) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t", "part", "tail")), strict=True)):
                if tail and (last is None or last[3] != p):
                    continue  # the row before has met its next one
                own = last[2] if last is not None and last[1] == x else Print(x.encode())
                if last is not None and last[3] == p:
                    keys.append(last[0])
                    out.append(pair(last[1], last[2], x, own))
                last = None if tail else (batch.column("k").slice(i, 1), x, own, p)
            if out:
                columns = dict(zip(fields.names[1:], map(list, zip(*out, strict=True)), strict=True))
                yield record({key: pa.concat_arrays(keys), **columns}, fields)

    return placed.mapInArrow(run, schema)
