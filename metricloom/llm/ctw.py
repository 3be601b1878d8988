"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions, each made in the context of the bytes before it. A node of a context of d bytes keeps
how often its decision went either way; its Krichevsky-Trofimov estimate is weighed against its children, the contexts
one byte longer, by the probability that either gives the whole training text. The posterior weights mix the estimates of
all depths into the probability of each byte; a context that training never held has estimate and probability one half.

Text counts never meet in one place. Documents stand in blocks of bounded bytes, written once. A block asks for each
distinct string of ``DEPTH`` context bytes and one more, and for each word that it holds, with the counts of its training
documents. The requests go to buckets by the nearest four context bytes, where counts of a string are summed; only the
distinct strings go on to parts by the nearest three, which hold whole subtrees from there on, so a common context costs
what it has of different strings and not what the corpus has of it. The at most 65,536 contexts of depth two and less are
summed over all parts and sent to all. Probabilities go back to the buckets, and from there to the blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import LOWER, as_bytes, checkpointed, fold, record, slices_of

#: Context bytes at most; with the byte that follows they stand in 64 bits. From ``SHALLOW`` on a part holds whole subtrees.
DEPTH, SHALLOW = 6, 3
#: Bits behind the nearest four and the nearest three context bytes of a string.
BY_FOUR, BY_THREE = 8 * (DEPTH - 3), 8 * (DEPTH - 2)
#: Bytes of text in a block, and of text whose strings are sorted at a time; distinct strings in a part.
BLOCK_BYTES, SORT_BYTES, PART_STRINGS = 24_000_000, 3_000_000, 200_000
END = b"\n"  # no word, so it can stand for the end among them
WORDS, STRINGS = 0, 1
U = np.uint64

def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series eight places up."""
    y = x + 8.0
    down = np.ones_like(y)
    for i in range(8):
        down = down * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(down)


class LogGamma:
    """Logarithms of the gamma function at whole numbers and a shift: small ones from a table."""

    def __init__(self, shift: float, size: int = 4096) -> None:
        self.shift, self.table = shift, log_gamma(np.arange(size) + shift)

    def __call__(self, n: np.ndarray) -> np.ndarray:
        at = np.minimum(n, len(self.table) - 1).astype(np.int64)
        out = self.table[at]
        large = np.flatnonzero(n >= len(self.table))
        out[large] = log_gamma(n[large] + self.shift)
        return out


AT_HALF, AT_ONE = LogGamma(0.5), LogGamma(1.0)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    return AT_HALF(zeros) + AT_HALF(ones) - AT_ONE(zeros + ones) - 2 * 0.5723649429247001


class Level:
    """The nodes of one depth: sorted strings (context from the nearest byte on, then the byte) and their runs.

    A node of j known bits is the run of strings that agree but for the last 8 - j bits.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, below: tuple | None) -> None:
        self.keys, self.counts = keys, n
        self.starts, self.weight, self.one, self.total, self.n = [], [], [], [], []
        for j in range(8):
            head = keys >> U(8 - j)
            run = np.concatenate(([True], head[1:] != head[:-1]))
            starts = np.flatnonzero(run)
            bit = (keys >> U(7 - j)) & U(1)
            count, ones = np.add.reduceat(n, starts), np.add.reduceat(n * bit, starts)
            own = log_estimate(count - ones, ones)
            if below is None:
                weight, total = np.ones(len(starts)), own
            else:
                child, to = below
                parents = (np.cumsum(run) - 1)[to[child.starts[j]]]
                total = np.logaddexp(own, np.bincount(parents, child.total[j], len(starts))) - np.log(2)
                weight = np.exp(own - np.log(2) - total)
            self.starts.append(starts)
            self.n.append(count)
            self.total.append(total)
            self.weight.append(weight)
            self.one.append((ones + 0.5) / (count + 1.0))

    def parents(self) -> tuple[np.ndarray, np.ndarray]:
        """Strings without the farthest context byte, and where each string goes."""
        return np.unique(self.keys >> U(16) << U(8) | self.keys & U(255), return_inverse=True)


def levels(keys: np.ndarray, n: np.ndarray, last: int, depth: int = DEPTH, below: tuple | None = None) -> tuple[list[Level], list[np.ndarray]]:
    """Levels from ``depth`` down to ``last``, and where the strings of each go in the next, one more than the last too."""
    out, to = [], []
    for d in range(depth, last - 1, -1):
        out.append(level := Level(keys, n, below))
        if d:
            keys, at = level.parents()
            n = np.bincount(at, n, len(keys))
            below = (level, at)
            to.append(at)
    return out, to


def upper(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[Level]:
    """Levels below ``SHALLOW`` from sums over all parts: of each number of known bits, nodes, counts and logs of children."""

    class Sums:  # what a Level needs of the one below it
        pass

    keys, n, _ = found[8]
    sums = Sums()
    sums.starts, sums.total = [], []
    for j in range(8):
        nodes, _, logs = found[j]
        sums.starts.append(np.searchsorted(keys, nodes << U(8 - j)))
        sums.total.append(logs)
    return levels(keys, n, 0, SHALLOW - 1, (sums, np.arange(len(keys))))[0]


def node_sums(keys: np.ndarray, n: np.ndarray) -> dict:
    """What ``upper`` adds up, of the strings of one part: ``j, node, n, s``."""
    found, to = levels(keys, n, SHALLOW)
    level, at = found[-1], to[-1]
    parents = np.unique(at, return_index=True)[1]
    short = (level.keys >> U(16) << U(8) | level.keys & U(255))[parents]
    rows = [(8, short, np.bincount(at, level.counts), np.zeros(len(short)))]
    for j in range(8):
        head = short >> U(8 - j)
        run = np.cumsum(np.concatenate(([True], head[1:] != head[:-1]))) - 1
        own = run[at[level.starts[j]]]
        rows.append((j, head[np.unique(run, return_index=True)[1]], np.bincount(own, level.n[j]), np.bincount(own, level.total[j])))
    keep = [r[2] > 0 for r in rows]
    return {
        "j": np.repeat([r[0] for r in rows], [int(k.sum()) for k in keep]),
        "node": np.concatenate([r[1][k] for r, k in zip(rows, keep, strict=True)]).view(np.int64),
        "n": np.concatenate([r[2][k] for r, k in zip(rows, keep, strict=True)]),
        "s": np.concatenate([r[3][k] for r, k in zip(rows, keep, strict=True)]),
    }


def log10_of(keys: np.ndarray, n: np.ndarray, top: list[Level]) -> np.ndarray:
    """log10 of the probability of the last byte of each of a part's sorted strings after those before it."""
    found, to = levels(keys, n, SHALLOW)
    found, to = found[::-1], to[::-1]
    short = np.unique(found[0].keys >> U(16) << U(8) | found[0].keys & U(255))
    out = np.zeros(len(keys))
    for j in range(8):
        bit = (short >> U(7 - j)) & U(1) == 1
        p, rest = np.zeros(len(short)), np.ones(len(short))
        for d, level in enumerate(reversed(top)):
            code = (short >> U(8 * (SHALLOW - d)) << U(8) | short & U(255)) >> U(8 - j)
            nodes = level.keys[level.starts[j]] >> U(8 - j)
            at = np.minimum(np.searchsorted(nodes, code), max(len(nodes) - 1, 0))
            there = nodes[at] == code if len(nodes) else np.zeros(len(code), bool)
            one = np.where(there, level.one[j][at], 0.5) if len(nodes) else 0.5
            weight = np.where(there, level.weight[j][at], 0.5) if len(nodes) else 0.5
            p, rest = p + rest * weight * np.where(bit, one, 1 - one), rest * (1 - weight)
        for level, at in zip(found, to, strict=True):
            run = np.repeat(np.arange(len(level.starts[j])), np.diff(np.append(level.starts[j], len(level.keys))))
            one, weight = level.one[j][run], level.weight[j][run]
            own = np.where((level.keys >> U(7 - j)) & U(1) == 1, one, 1 - one)
            p, rest = p[at] + rest[at] * weight * own, rest[at] * (1 - weight)
        out += np.log10(p)
    return out


def pack(values: np.ndarray, kept: int | None = None) -> bytes:
    """Compressed with bytes of like significance together; only the ``kept`` more significant ones."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes[values.itemsize - kept :].tobytes() if kept else planes.tobytes())


def unpack(data: bytes, kind: type, kept: int | None = None) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(kept or width, -1)
    out = np.zeros((planes.shape[1], width), np.uint8)
    out[:, width - len(planes) :] = planes.T
    return out.view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pack_logs(values: np.ndarray) -> bytes:
    """With 16 bits after the first one: exact to some millionths of a value."""
    return pack((values.astype(np.float32).view(np.uint32) + np.uint32(128)) & np.uint32(0xFFFFFF00), 3)


def unpack_logs(data: bytes) -> np.ndarray:
    return unpack(data, np.uint32, 3).view(np.float32)


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The string that ends at each byte and at the end of each text, and the number of strings of each."""
    pad = bytes(DEPTH)
    a = np.frombuffer(b"".join(chain.from_iterable((pad, x, b"\0") for x in texts)), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    n = len(a) - DEPTH
    keys = np.zeros(max(n, 0), U)
    for i in range(1, DEPTH + 1):  # the nearest byte first
        keys <<= U(8)
        keys |= a[DEPTH - i : DEPTH - i + n]
    keys <<= U(8)
    keys |= a[DEPTH:]
    ok = np.ones(len(keys), bool)
    ends = np.cumsum(sizes + DEPTH)[:-1]
    for i in range(1, DEPTH + 1):
        ok[ends - i] = False  # strings over two texts
    return keys[ok], sizes


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), U, len(words))


def slices(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, x in enumerate(texts):
        if held and held + len(x) > size:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield start, len(texts)


def spread(keys: np.ndarray, count: int, shift: int) -> np.ndarray:
    """Number below ``count`` by a hash of the keys without their last ``shift`` bits."""
    return ((keys >> U(shift)) * U(0x9E3779B97F4A7C15) >> U(32)) % U(count)


def dealt(keys: np.ndarray, to: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers with any keys, and the places of these."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(count + 1)).tolist()
    for b, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if e > s:
            yield b, order[s:e]


def joined(keys: np.ndarray, n: np.ndarray, more: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct keys as one, with the sums of their counts."""
    both = np.concatenate((keys, more))
    order = np.argsort(both, kind="stable")  # merges the two runs
    both = both[order]
    starts = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    return both[starts], np.add.reduceat(np.concatenate((n, new))[order], starts)


def block_strings(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of a block and how often its training documents hold them."""
    found = None
    for s, e in slices(texts, SORT_BYTES):
        keys, sizes = strings(texts[s:e])
        learn = np.repeat(train[s:e], sizes)
        for own, counted in ((keys[learn], True), (keys[~learn], False)):
            if len(own):
                own, n = np.unique(own, return_counts=True)
                n = n.astype(np.uint32) if counted else np.zeros(len(own), np.uint32)
                found = (own, n) if found is None else joined(*found, own, n)
    return found


def block_words(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of hashed words and ends."""
    counted: Counter = Counter()
    for x, t in zip(texts, train.tolist(), strict=True):
        if t:
            counted.update(x.split())
            counted[END] += 1
        else:
            counted.update(dict.fromkeys([*x.split(), END], 0))
    hashes, inverse = np.unique(word_hashes(list(counted)), return_inverse=True)
    return hashes, np.bincount(inverse, np.fromiter(counted.values(), float, len(counted)), len(hashes))


class Table:
    """Values by key: keys stand in the order of their hashes, whose first bits tell where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = U(64 - bits)
        slots = self._slots(keys)
        order = np.argsort(slots, kind="stable")
        self.keys, self.values = keys[order], values[order]
        held = np.bincount(slots, minlength=1 << bits)
        self.starts = (np.cumsum(held) - held).astype(np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.starts[self._slots(keys)]
        open_ = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys)
        while len(open_):
            at[open_] += 1
            if (at[open_] >= len(self.keys)).any():
                raise KeyError("a string of the block has no answer")
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        return self.values[at]


class Block:
    """Rows of a block as compressed Arrow."""

    @staticmethod
    def packed(parts: list[pa.RecordBatch]) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=8))) as out:
            for x in parts:
                out.write_batch(x)
        return sink.getvalue().to_pybytes()

    def __init__(self, payload: bytes) -> None:
        table = pa.ipc.open_stream(payload).read_all()
        self.keys = table.column("k")
        self.texts = [x.translate(LOWER) for c in table.column("text").chunks for x in as_bytes(c)]
        self.train = np.array(table.column("train").to_pylist(), bool)


def score(df: DataFrame, train, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, part_strings: int = PART_STRINGS) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` for each row; ``train``: a column, true for rows to learn from.

    ``score`` is the log10 probability of the lower-cased text's bytes and its end; ``-score / log10(2)`` over its bytes
    plus one is the code length for each. ``base_score`` is that of its words and end, each by its add-half frequency
    among the training words. A null text is empty; rows repeat as they stand; without training rows every decision has
    probability one half. An empty table gives no rows. Only the key, the text and ``train`` are read.
    """
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    shape = lambda ddl: spark.createDataFrame([], ddl).schema
    docs = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text}`").alias("text"))

    held_fields = to_arrow_schema(shape("block long, size long, payload binary"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows; each ends where its bytes are full."""
        number, held, parts = TaskContext.get().partitionId() << 24, 0, []

        def flush() -> pa.RecordBatch:
            return record({"block": [number], "size": [held], "payload": [Block.packed(parts)]}, held_fields)

        for batch in slices_of(batches):
            start = 0
            for i, size in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()):
                if held and held + size > block_bytes:
                    if i > start:
                        parts.append(batch.slice(start, i - start))
                    yield flush()
                    number, start, held, parts = number + 1, i, 0, []
                held += size
            if start < len(batch):
                parts.append(batch.slice(start))
        if parts:
            yield flush()

    # numbered once and written: what is asked for and what is scored must be the same blocks
    blocks = checkpointed(docs.mapInArrow(hold, shape("block long, size long, payload binary")))
    buckets = max(16, 2 * -(-(blocks.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    columns = "kind int, bucket int, block long, size long, total double, seen long, keys binary, counts binary"

    def rows_of(kind: int, bucket: int, block: int, keys: np.ndarray, n: np.ndarray) -> tuple:
        return kind, bucket, block, len(keys), float(n.sum()), int((n > 0).sum()), pack_keys(keys), pack(n.astype(np.uint64))

    def by_column(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
        return record(dict(zip(fields.names, map(list, zip(*rows, strict=True)) if rows else [[] for _ in fields], strict=True)), fields)

    asked_fields = to_arrow_schema(shape(columns))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, 1):
            block, number = Block(batch.column("payload")[0].as_py()), batch.column("block")[0].as_py()
            for kind, (keys, n), shift in ((STRINGS, block_strings(block.texts, block.train), BY_FOUR), (WORDS, block_words(block.texts, block.train), 0)):
                yield by_column([rows_of(kind, b, number, keys[at], n[at]) for b, at in dealt(keys, spread(keys, buckets, shift), buckets)], asked_fields)

    asked = checkpointed(blocks.mapInArrow(ask, shape(columns)))

    def add_up(table: pa.Table) -> pa.Table:
        """The distinct keys of a bucket and their counts over all blocks."""
        keys = np.concatenate([unpack_keys(x) for x in table.column("keys").to_pylist()])
        n = np.concatenate([unpack(x, np.uint64) for x in table.column("counts").to_pylist()]).astype(float)
        keys, inverse = np.unique(keys, return_inverse=True)
        kind, bucket = (table.column(c)[0].as_py() for c in ("kind", "bucket"))
        return pa.Table.from_batches([by_column([rows_of(kind, bucket, 0, keys, np.bincount(inverse, n, len(keys)))], asked_fields)])

    distinct = checkpointed(asked.groupBy("kind", "bucket").applyInArrow(add_up, shape(columns)))
    sums = {r.kind: r for r in distinct.groupBy("kind").agg(F.sum("size").alias("size"), F.sum("total").alias("total"), F.sum("seen").alias("seen")).collect()}
    total, known = (float(sums[WORDS].total), float(sums[WORDS].seen)) if sums else (0.0, 0.0)
    count = -(-sums[STRINGS].size // part_strings) if sums else 1
    parted_fields = to_arrow_schema(shape("part int, bucket int, keys binary, counts binary"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, 1):
            keys, n = unpack_keys(batch.column("keys")[0].as_py()), unpack(batch.column("counts")[0].as_py(), np.uint64)
            bucket = batch.column("bucket")[0].as_py()
            yield by_column([(b, bucket, pack_keys(keys[at]), pack(n[at])) for b, at in dealt(keys, spread(keys, count, BY_THREE), count)], parted_fields)

    parts = distinct.where(F.col("kind") == STRINGS).mapInArrow(deal, shape("part int, bucket int, keys binary, counts binary")).groupBy("part")

    def merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        own = [unpack_keys(x) for x in table.column("keys").to_pylist()]
        keys = np.concatenate(own)
        order = np.argsort(keys)
        return own, keys[order], np.concatenate([unpack(x, np.uint64) for x in table.column("counts").to_pylist()]).astype(float)[order], order

    nodes_fields = to_arrow_schema(shape("j int, node long, n double, s double"))

    def subtree_sums(table: pa.Table) -> pa.Table:
        _, keys, n, _ = merged(table)
        return pa.Table.from_batches([record({c: pa.array(x) for c, x in node_sums(keys, n).items()}, nodes_fields)])

    # at most 65,536 contexts, of 511 nodes each
    found = parts.applyInArrow(subtree_sums, shape("j int, node long, n double, s double")).groupBy("j", "node").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    each = []
    for j in range(9):
        own = found.filter(pa.compute.equal(found.column("j"), j)).sort_by("node")
        each.append((own.column("node").to_numpy().astype(np.int64).view(U), own.column("n").to_numpy().astype(float), own.column("s").to_numpy().astype(float)))
    top = upper(each) if len(each[8][0]) else []

    value_fields = to_arrow_schema(shape("kind int, bucket int, keys binary, answers binary"))

    def probabilities(table: pa.Table) -> pa.Table:
        own, keys, n, order = merged(table)
        values = np.empty(len(keys))
        values[order] = log10_of(keys, n, top)
        cuts = np.cumsum([len(x) for x in own])[:-1]
        rows = {"kind": [STRINGS] * len(own), "bucket": table.column("bucket").combine_chunks(), "keys": table.column("keys").combine_chunks(), "answers": [pack_logs(x) for x in np.split(values, cuts)]}
        return pa.Table.from_batches([record(rows, value_fields)])

    values = parts.applyInArrow(probabilities, shape("kind int, bucket int, keys binary, answers binary"))
    values = values.unionAll(distinct.where(F.col("kind") == WORDS).select("kind", "bucket", "keys", F.col("counts").alias("answers")))
    answer_fields = to_arrow_schema(shape("block long, kind int, bucket int, answers binary"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            kind, bucket = (left.column(c)[0].as_py() for c in ("kind", "bucket"))
            keys = np.concatenate([unpack_keys(x) for x in right.column("keys").to_pylist()])
            logs = kind == STRINGS
            held = np.concatenate([unpack_logs(x) if logs else unpack(x, np.uint64) for x in right.column("answers").to_pylist()])
            order = np.argsort(keys)
            keys, held = keys[order], held[order]
            for block, wanted in zip(left.column("block").to_pylist(), left.column("keys").to_pylist(), strict=True):
                wanted = unpack_keys(wanted)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                if (keys[at] != wanted).any():
                    raise ValueError("a block asks for a string that no bucket holds")
                rows.append((block, kind, bucket, pack_logs(held[at]) if logs else pack(held[at])))
        return pa.Table.from_batches([by_column(rows, answer_fields)])

    asks = asked.select("kind", "bucket", "block", "keys")
    answers = asks.groupBy("kind", "bucket").cogroup(values.groupBy("kind", "bucket")).applyInArrow(answer, shape("block long, kind int, bucket int, answers binary"))

    kind = docs.schema["k"].dataType.simpleString()
    out_schema = shape(f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out_fields = to_arrow_schema(out_schema)

    def in_order(right: pa.Table, kind: int, keys: np.ndarray, shift: int) -> np.ndarray:
        """Answers to the block's distinct keys."""
        own = right.filter(pa.compute.equal(right.column("kind"), kind))
        by_bucket = dict(zip(own.column("bucket").to_pylist(), own.column("answers").to_pylist(), strict=True))
        out = np.empty(len(keys), np.float32 if kind == STRINGS else np.float64)
        for b, at in dealt(keys, spread(keys, buckets, shift), buckets):
            out[at] = unpack_logs(by_bucket[b]) if kind == STRINGS else unpack(by_bucket[b], np.uint64)
        return out

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=out_fields)
        block = Block(left.column("payload")[0].as_py())
        spans, keys = list(slices(block.texts, SORT_BYTES)), None
        for s, e in spans:
            own = np.unique(strings(block.texts[s:e])[0])
            keys = own if keys is None else joined(keys, np.zeros(len(keys), np.uint8), own, np.zeros(len(own), np.uint8))[0]
        logs = Table(keys, in_order(right, STRINGS, keys, BY_FOUR))
        del keys
        words = np.unique(word_hashes(list({END, *chain.from_iterable(x.split() for x in block.texts)})))
        counts = in_order(right, WORDS, words, 0)
        rows, scores = [np.zeros(0)] * 3, np.zeros(0)
        for s, e in spans:
            own, n = strings(block.texts[s:e])
            scores = np.concatenate((scores, np.add.reduceat(logs(own).astype(float), np.cumsum(n) - n)))
            tokens = [[*x.split(), END] for x in block.texts[s:e]]
            told = {w: None for w in chain.from_iterable(tokens)}
            told = dict(zip(told, counts[np.searchsorted(words, word_hashes(list(told)))].tolist(), strict=True))
            n = np.fromiter(map(len, tokens), np.int64, len(tokens))
            c = np.fromiter(map(told.__getitem__, chain.from_iterable(tokens)), float, int(n.sum()))
            starts = np.cumsum(n) - n
            base = np.add.reduceat(np.log10((c + 0.5) / (total + 0.5 * (known + 1))), starts)
            rows = [np.concatenate(x) for x in zip(rows, (n, np.add.reduceat((c > 0).astype(np.int64), starts), base), strict=True)]
        out = {key: block.keys.combine_chunks(), "n_tokens": pa.array(rows[0]), "n_known": pa.array(rows[1]), "train_tokens": [int(total)] * len(scores), "base_score": pa.array(rows[2]), "score": pa.array(scores)}
        return pa.Table.from_batches([record(out, out_fields)])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, out_schema)


def scored(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """``score`` learning from the rows whose fold is not ``held_out``; ``held_out`` tells which rows were not learned from."""
    return score(df, fold(key, folds) != held_out, key, text).withColumn("held_out", fold(key, folds) == held_out)
