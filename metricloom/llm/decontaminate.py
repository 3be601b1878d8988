"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Documents stream through the automaton, which tracks the longest run of words up to each place that stands in an item.
A run of ``window`` words or more is a hit, and so is the whole of a shorter item. The automaton is built from items of a
bounded number of words. Of a larger benchmark only those items matter that have a window in common with the documents,
which a join of hashes tells; they are dealt with block after block, each over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import LOWER, as_bytes, checkpointed, extended, map_batches, record, slices_of

WINDOW = 10
#: Words of the items in one automaton: at most twice as many states, some 100 MB.
BLOCK_WORDS = 100_000
#: Everything but digits, letters and what is beyond ASCII becomes a blank; A-Z become a-z.
WORD_BYTES = bytes(LOWER[b] if 48 <= b <= 57 or 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256))
SPOT = re.compile(rb"[^\x20]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.whole: dict[int, list[tuple[int, str]]] = {}  # by state: short items that end there
        ends: dict[int, set[str]] = {}
        sizes = [len(w) for _, w in items if w]
        self.shortest = min([window, *sizes])
        for item, sequence in items:
            state = 0
            for x in sequence:
                state = self._extend(state, self.ids.setdefault(x, len(self.ids)))
                ends.setdefault(state, set()).add(item)
        for item, sequence in items:  # the automaton is complete: where each short item ends
            if 0 < len(sequence) < window:
                state = 0
                for x in sequence:
                    state = self.next[state][self.ids[x]]
                self.whole.setdefault(state, []).append((len(sequence), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        self.items: dict[int, set[str]] = {}  # of the states that hold a run of just ``window`` words
        gathered = ends
        for s in order:
            up = self.link[s]
            if s in gathered:
                if self.length[up] < window <= self.length[s]:
                    self.items[s] = gathered[s]
                elif self.length[up] >= window:
                    gathered.setdefault(up, set()).update(gathered[s])
        self.above = [-1] * len(self.link)  # the nearest state up the links at which a short item ends
        for s in reversed(order):
            up = self.link[s]
            self.above[s] = up if up in self.whole else self.above[up]

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _state(self, length: int, arrows: dict) -> int:
        self.next.append(arrows)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def scan(self, sequence: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal hit spans, as first word and end, and the items with a window that occurs."""
        spans: list[list[int]] = []
        found: set[str] = set()
        known = np.fromiter(map(self.ids.get, sequence, [-1] * len(sequence)), np.int32, len(sequence))
        bounds = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0]))))
        for start, end in bounds.reshape(-1, 2).tolist():
            if end - start >= self.shortest:  # a word that no item has ends every run
                self._run(known[start:end].tolist(), start, spans, found)
        spans.sort()
        merged: list[list[int]] = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        return merged, found

    def _run(self, ids: list[int], start: int, spans: list, found: set[str]) -> None:
        arrows, link, length, window, whole, above = self.next, self.link, self.length, self.window, self.whole, self.above
        state = n = 0
        for at, x in enumerate(ids, start + 1):
            while (to := arrows[state].get(x)) is None and state:
                state = link[state]
                n = length[state]
            if to is None:
                continue
            state, n = to, n + 1
            if n >= window:
                if spans and at - n <= spans[-1][1] and spans[-1][0] <= at - n:
                    spans[-1][1] = at
                else:
                    spans.append([at - n, at])
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                found |= self.items[s]
            if whole:
                s = state if state in whole else above[state]
                while s > 0:
                    for size, item in whole[s]:
                        if size <= n:
                            spans.append([at - size, at])
                            found.add(item)
                    s = above[s]


@lru_cache(maxsize=2)
def _automaton(items: tuple, window: int) -> Automaton:
    return Automaton([(i, list(w)) for i, w in items], window)


class Block:
    """Items of one automaton, built once in each worker; the digest stands for them in the cache."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.items, self.window = tuple((i, tuple(w)) for i, w in items), window

    def automaton(self) -> Automaton:
        return _automaton(self.items, self.window)


def item_blocks(items: DataFrame, item: str, text: str, window: int, limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """Blocks of at most ``limit`` words; a longer item is cut into pieces that overlap by a window less a word."""
    held: list[tuple[str, list[bytes]]] = []
    size, first = 0, True
    for row in items.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        sequence = words((row.t or "").encode())
        pieces = [sequence] if len(sequence) <= limit else [sequence[k : k + limit] for k in range(0, len(sequence) - window + 1, limit - window + 1)]
        for piece in pieces:
            if held and size + len(piece) > limit:
                yield Block(held, window)
                held, size, first = [], 0, False
            if piece:
                held.append((row.i or "", piece))
                size += len(piece)
    if held or first:
        yield Block(held, window)


def few_words(items: DataFrame, text: str, limit: int) -> bool:
    """Whether the items have no more than about ``limit`` words: a word takes two bytes with what parts it from the next."""
    return (items.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0) <= 2 * limit


#: Bits of the map of item windows that tasks test documents against: 8 MB, however many windows there are.
MAP_BITS = 1 << 26


def window_map(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash (column ``h``); hashes are summed to words of bits by Spark, so at most ``MAP_BITS`` bits come here."""
    place = F.pmod("h", F.lit(MAP_BITS))
    words_ = hashes.select(F.floor(place / 64).cast("int").alias("w"), (place % 64).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words_.column("w").to_numpy()] = words_.column("bits").to_numpy()
    return out.view(np.uint64)


def occurring(items: DataFrame, docs: DataFrame, item_text: str, text: str, window: int, limit: int) -> DataFrame:
    """The items that can occur in the documents: all of a benchmark of about ``limit`` words or fewer, else those with a window
    whose hash the documents have, and those shorter than a window.

    A map of the items' hashes, of one size, goes to the tasks, and only windows of documents that it has move on.
    """
    if few_words(items, item_text, limit):
        return items
    from xxhash import xxh3_64_intdigest

    def hashed(column: str, known: np.ndarray | None = None):
        def run(batch: pa.RecordBatch) -> dict:
            out, at = [], []
            for k, x in enumerate(as_bytes(batch.column("text"))):
                w = words(x)
                found = np.array([xxh3_64_intdigest(b" ".join(w[i : i + window])) - (1 << 63) for i in range(len(w) - window + 1)], np.int64)
                if known is not None:
                    place = found & np.int64(MAP_BITS - 1)
                    found = found[known[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1) > 0]
                none = [None] if column == "id" and len(w) < window else []
                out += [*found.tolist(), *none]
                at += [k] * (len(found) + len(none))
            return {"h": out} if column == "h" else {"h": out, "id": batch.column("id").take(pa.array(at, pa.int64()))}

        return run

    kept = items.select(F.struct(*(F.col(f"`{c}`") for c in items.columns)).alias("item"), F.md5(F.coalesce(F.col(f"`{item_text}`"), F.lit(""))).alias("id"))
    own = checkpointed(map_batches(kept.select("id", F.col("item")[item_text].alias("text")), hashed("id"), "h long, id string"))
    known = window_map(own.where("h is not null"))
    there = map_batches(docs.select(F.col(f"`{text}`").alias("text")), hashed("h", known), "h long").distinct()
    wanted = own.join(there, "h", "left_semi").unionAll(own.where("h is null")).select("id").distinct()
    return checkpointed(kept.join(wanted, "id", "left_semi").select("item.*"))


def _scan(df: DataFrame, text: str, block: Block, schema, keep: list[str]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.automaton()
        for batch in slices_of(batches):
            n, spans, found = [], [], []
            for x in as_bytes(batch.column(text)):
                sequence = words(x)
                n.append(len(sequence))
                s, f = automaton.scan(sequence)
                spans.append(s)
                found.append(sorted(f))
            yield record({**{c: batch.column(c) for c in keep}, "n_words": n, "spans": spans, "items": found}, fields)

    return df.mapInArrow(run, schema)


def _merge(spans: Iterable[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key, n_words, spans, items`` for each row: hit spans as ``[first word, end)``, and the ids of the items found.

    A null text has no words. Null item ids count as the empty text; items without words are never found; an item that is
    there twice counts once for each id. Repeated rows stay. Other columns are not read.
    """
    schema = extended(docs.select(key), n_words="long", spans="array<array<bigint>>", items="array<string>")
    blocks = list(item_blocks(occurring(items, docs, item_text, text, window, block_words), item, item_text, window, block_words))
    if len(blocks) == 1:
        return _scan(docs.select(key, text), text, blocks[0], schema, [key])
    rows = checkpointed(docs.select(F.monotonically_increasing_id().alias("row"), key, text))
    whole = rows.select("row", key, text)
    one = extended(whole.select("row", key), n_words="long", spans="array<array<bigint>>", items="array<string>")
    hits = None
    for block in blocks:
        found = _scan(whole, text, block, one, ["row", key])
        hits = found if hits is None else hits.unionAll(found.where("size(items) > 0"))
    merged = hits.groupBy("row").agg(F.first(key).alias(key), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    kind = docs.schema[key].dataType.simpleString()

    def join(batch: pa.RecordBatch) -> dict:
        spans = [_merge([list(s) for s in own]) for own in batch.column("spans").to_pylist()]
        return {**{c: batch.column(c) for c in ("k", "n_words", "items")}, "spans": spans}

    out = map_batches(merged.withColumnRenamed(key, "k"), join, f"k {kind}, n_words long, spans array<array<bigint>>, items array<string>")
    return out.withColumnRenamed("k", key)


def remove(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without their hit spans; a span gives way to a line end. All columns stay.

    A document with more than ``max_coverage`` of its words hit, by the items of all blocks together, goes whole. What
    comes together around a cut is searched again for all items until nothing is found. A text without hits, null or empty
    ones included, is left as it is.
    """
    if few_words(items, item_text, block_words):
        blocks = list(item_blocks(items, item, item_text, window, block_words))
        if len(blocks) == 1:
            return _cut(docs, text, blocks[0], max_coverage)
    names, row = docs.columns, "row"
    docs = checkpointed(docs.select(F.monotonically_increasing_id().alias(row), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc")))
    todo = docs.select(row, F.col("doc")[text].alias("text"))
    done = None
    while True:
        # what a cut brings together may be of an item that did not occur before
        blocks = list(item_blocks(occurring(items, todo, item_text, "text", window, block_words), item, item_text, window, block_words))
        shape = extended(todo.select(row), n_words="long", spans="array<array<bigint>>", items="array<string>")
        hits = reduce(DataFrame.unionAll, (_scan(todo, "text", block, shape, [row]).where("size(items) > 0") for block in blocks))
        spans = hits.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("spans"))
        cut = checkpointed(_cut_spans(todo.join(spans, row), row, max_coverage))
        if cut.isEmpty():
            break
        done = cut if done is None else checkpointed(done.join(cut.select(row), row, "left_anti").unionAll(cut))
        todo = cut.where("stays").select(row, "text")
    if done is None:
        return docs.select("doc.*")
    kept = docs.join(done.select(row, "text", "stays"), row, "left").where("coalesce(stays, true)")
    return kept.select(*(F.coalesce("text", F.col("doc")[c]).alias(c) if c == text else F.col("doc")[c].alias(c) for c in names))


def _without(data: bytes, spans: list[list[int]]) -> bytes:
    """The text with a line end in place of each span of words."""
    places = [m.span() for m in SPOT.finditer(data.translate(WORD_BYTES))]
    parts, at = [], 0
    for s, e in spans:
        parts.append(data[at : places[s][0]])
        at = places[e - 1][1]
    return b"\n".join([*parts, data[at:]])


def _cut_spans(found: DataFrame, row: str, max_coverage: float) -> DataFrame:
    """``row, text, stays``: the texts without their ``spans``, and whether these are few enough for the rest to stay."""

    def run(batch: pa.RecordBatch) -> dict:
        out, stays = [], []
        for x, given in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            spans = _merge([list(s) for s in given])
            stays.append(sum(e - s for s, e in spans) <= max_coverage * len(words(x)))
            out.append(_without(x, spans).decode() if stays[-1] else None)
        return {row: batch.column(row), "text": out, "stays": stays}

    return map_batches(found, run, f"{row} long, text string, stays boolean")


def _cut(docs: DataFrame, text: str, block: Block, max_coverage: float) -> DataFrame:
    names, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.automaton()
        for batch in slices_of(batches):
            column = batch.column(place)
            out, keep, changed = column.to_pylist(), [], False
            for k, x in enumerate(out):
                data, stays = (x or "").encode(), True
                while True:
                    sequence = words(data)
                    spans, _ = automaton.scan(sequence)
                    if not spans:
                        break
                    if sum(e - s for s, e in spans) > max_coverage * len(sequence):
                        stays = False
                        break
                    data = _without(data, spans)
                    out[k], changed = data.decode(), True
                keep.append(stays)
            if changed:
                batch = batch.set_column(place, batch.schema.field(place), pa.array(out, column.type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return numbered.mapInArrow(run, numbered.schema).toDF(*names)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and the SHA-256 of the comma-joined item ids, for each row of ``matches``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )

