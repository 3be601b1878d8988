"""How the sources of each language differ in their terms, with text left where it was read until a row of the result needs it.

A task counts the terms of its documents by their bytes and gives each a digest of fixed width. Only digests and counts
move, until the kept ones are known; then the least and the greatest string of each kept digest tell whether two terms
share it, and such digests are told apart by their strings. Terms come back as text for the rows that are given out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import LOWER, as_bytes, checkpointed, discard, slices_of

#: Documents that hold a term of a language at least, and ranks of terms that are given out.
LEAST_DOCUMENTS, RANKS = 3, 200
SCALE = 1_000_000_000
#: Bytes of text whose terms are looked at together, and terms times sources that a task holds before it gives them out.
PIECE_BYTES, HELD = 4_000_000, 1_000_000
#: Terms whose probabilities meet in one group, and numbers in a matrix of terms by sources.
GROUP_TERMS, MATRIX = 20_000, 2_000_000

#: Bytes of terms: letters of ASCII and all bytes of other characters.
IN_TERM = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_NUMBERS = np.random.default_rng(12).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Digests:
    """Digests of stretches of bytes, all of them at once: differences of one running sum of hashed bytes times powers."""

    def __init__(self, bits: int = 64):
        self.mask = np.uint64((1 << bits) - 1)
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data):
            n = 1 << (len(data) - 1).bit_length()
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_NUMBERS[data] * self.up[: len(data)], out=running[1:])
        x = (running[end] - running[start]) * self.down[start]
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (x & self.mask).view(np.int64)


def pieces(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of about so many bytes that end where no term goes on."""
    start = 0
    while start < len(data):
        end = min(start + most, len(data))
        while end < len(data) and IN_TERM[data[end - 1]]:
            gap = np.flatnonzero(~IN_TERM[data[end : end + most]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + most, len(data))
        yield start, end
        start = end


class Counter:
    """Terms of a task's documents: how many documents hold each, and how often each source of its language does."""

    def __init__(self, bits: int = 64):
        self.digest_of, self.numbers = Digests(bits), {}
        self.clear()

    def clear(self) -> None:
        self.terms: dict[tuple[str, bytes], int] = {}
        self.digests: list[int] = []
        self.documents, self.postings, self.held = [], [], 0

    def add(self, texts: list[bytes], langs: list[str], sources: list[int]) -> None:
        data = np.frombuffer((b"\n".join(texts) + b"\n").translate(LOWER), np.uint8)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
        known = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        lang = np.array([known[x] for x in langs])
        found: list[tuple[np.ndarray, ...]] = []
        for s, e in pieces(data, PIECE_BYTES):
            part = data[s:e]
            edges = np.flatnonzero(np.diff(IN_TERM[part], prepend=False, append=False))
            start, end = edges[::2], edges[1::2]
            found.append((np.searchsorted(begins, start + s, "right") - 1, self.digest_of(part, start, end), start + s, end + s))
        doc, digest, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(doc):
            return
        number = self._numbered(data, lang[doc], digest, start, end, list(known))
        # within a document first, then within a source
        held, n = np.unique(doc * np.int64(len(self.terms)) + number, return_counts=True)
        of, number = np.divmod(held, len(self.terms))
        self.documents.append(number)
        both = number << 32 | np.array(sources, np.int64)[of]
        key, place = np.unique(both, return_inverse=True)
        self.postings.append((key, np.bincount(place, n).astype(np.int64)))
        self.held += len(key)

    def _numbered(self, data: np.ndarray, lang: np.ndarray, digest: np.ndarray, start: np.ndarray, end: np.ndarray, langs: list[str]) -> np.ndarray:
        """A number for each occurrence: the same one for the same bytes of the same language, whatever the digests."""
        order = np.lexsort((digest, lang))
        lang, digest, start, end = lang[order], digest[order], start[order], end[order]
        new = np.append(True, (np.diff(lang) != 0) | (np.diff(digest) != 0))
        size = end - start
        # runs of a digest are compared byte by byte with their first term
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        same = size == size[first]
        step = np.arange(size[same].sum()) - np.repeat(np.cumsum(size[same]) - size[same], size[same])
        differs = data[np.repeat(start[same], size[same]) + step] != data[np.repeat(start[first][same], size[same]) + step]
        same[same] = np.bincount(np.repeat(np.arange(same.sum()), size[same])[differs], minlength=same.sum()) == 0
        heads = np.append(np.flatnonzero(new), np.flatnonzero(~same))
        raw = data.tobytes()
        numbers = np.empty(len(heads), np.int64)
        for i, (h, code, d) in enumerate(zip(heads.tolist(), lang[heads].tolist(), digest[heads].tolist(), strict=True)):
            key = langs[code], raw[start[h] : end[h]]
            if (at := self.terms.get(key)) is None:
                self.terms[key] = at = len(self.digests)
                self.digests.append(d)
            numbers[i] = at
        runs = int(new.sum())
        out = np.empty(len(order), np.int64)
        out[order] = numbers[:runs][np.cumsum(new) - 1]
        out[order[~same]] = numbers[runs:]
        return out

    def rows(self) -> pa.RecordBatch | None:
        """``lang, digest, term, documents, sources, counts`` of what was added since the last time."""
        if not self.terms:
            return None
        key, place = np.unique(np.concatenate([k for k, _ in self.postings]), return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, place, np.concatenate([n for _, n in self.postings]))
        number = key >> 32
        at = pa.array(np.searchsorted(number, np.arange(len(self.terms) + 1)), pa.int32())
        documents = np.bincount(np.concatenate(self.documents), minlength=len(self.terms))
        langs, terms = zip(*self.terms, strict=True)
        columns = [pa.array(langs), pa.array(self.digests, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(documents, pa.int64())]
        columns += [pa.ListArray.from_arrays(at, pa.array((key & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(n))]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, ["lang", "digest", "term", "documents", "sources", "counts"])


def numbered_sources(df: DataFrame) -> DataFrame:
    """A written table ``lang, source, no``: the sources of each language, from 0 on by code point; nulls count as empty."""
    named = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    return checkpointed(named.withColumn("no", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")))


def counted(df: DataFrame, groups: DataFrame, bits: int = 64) -> DataFrame:
    """A written table ``lang, digest, term, documents, sources, counts``: a row for each term of a task's documents."""
    docs = df.select(F.col("text"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")))
    given = docs.join(groups, ["lang", "source"]).select("text", "lang", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(bits)
        for batch in slices_of(batches):
            texts, langs, numbers = as_bytes(batch.column("text")), batch.column("lang").to_pylist(), batch.column("no").to_pylist()
            start, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= PIECE_BYTES or i == len(texts) - 1:
                    counter.add(texts[start : i + 1], langs[start : i + 1], numbers[start : i + 1])
                    start, size = i + 1, 0
            if counter.held >= HELD:
                yield counter.rows()
        if (last := counter.rows()) is not None:
            yield last

    return checkpointed(given.mapInArrow(run, "lang string, digest long, term string, documents long, sources array<int>, counts array<long>"))


def kept_terms(table: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Written tables ``lang, digest, more, term`` of terms in at least so many documents, and of digests that terms share.

    Digests are counted first; strings are looked at for those alone that could be kept. ``more`` is 0, and tells the terms
    of a shared digest apart.
    """
    often = table.groupBy("lang", "digest").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= least).select("lang", "digest")
    ends = checkpointed(table.select("lang", "digest", "term").join(often, ["lang", "digest"]).groupBy("lang", "digest").agg(F.min("term").alias("term"), F.max("term").alias("high")))
    plain = ends.where("term = high").select("lang", "digest", F.lit(0).alias("more"), "term")
    shared = ends.where("term != high").select("lang", "digest")
    each = table.select("lang", "digest", "term", "documents").join(shared, ["lang", "digest"]).groupBy("lang", "digest", "term").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= least)
    number = F.row_number().over(Window.partitionBy("lang", "digest").orderBy("term"))
    return plain, checkpointed(each.select("lang", "digest", number.alias("more"), "term"))


def occurrences(table: DataFrame, plain: DataFrame, shared: DataFrame) -> DataFrame:
    """A written table ``lang, digest, more, sources, counts``: how often each source has each kept term."""
    columns = ("lang", "digest", "more", "sources", "counts")
    found = table.select("lang", "digest", "sources", "counts").join(plain.select("lang", "digest", "more"), ["lang", "digest"]).select(*columns)
    told = table.join(shared, ["lang", "digest", "term"]).select(*columns)
    each = found.unionAll(told).select("lang", "digest", "more", F.inline(F.arrays_zip("sources", "counts")))
    summed = each.groupBy("lang", "digest", "more", "sources").agg(F.sum("counts").alias("n"))
    # as many entries as a language has sources
    lists = summed.groupBy("lang", "digest", "more").agg(F.collect_list(F.struct(F.col("sources").alias("s"), "n")).alias("x"))
    return checkpointed(lists.select("lang", "digest", "more", F.col("x.s").alias("sources"), F.col("x.n").alias("counts")))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) by long division, exact for totals below 9e15."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def compared(rows: pa.Table, header: pa.Table, ranks: int) -> dict[str, np.ndarray]:
    """Of some terms of a language: sums for each two of its sources, and each source's terms that can be among the first.

    ``header``: ``no, total`` of every source, and the language's total as number -1.
    """
    order = np.argsort(header.column("no").to_numpy())
    totals = header.column("total").to_numpy()[order]
    whole, totals = totals[0], totals[1:]
    lists = [rows.column(c).combine_chunks() for c in ("sources", "counts")]
    size = lists[0].value_lengths().to_numpy()
    term = np.repeat(np.arange(len(size)), size)
    source, n = (x.flatten().to_numpy().astype(np.int64) for x in lists)
    p = shares(n + 1, totals[source])
    ends = np.append(0, np.cumsum(n))[np.cumsum(size)]
    q = shares(np.diff(ends, prepend=0) + 1, np.broadcast_to(whole, len(size)))[term]
    sums = np.zeros((len(totals), len(totals)), np.int64)
    step = max(1, MATRIX // len(totals))
    floor = shares(np.ones_like(totals), totals)
    for s in range(0, len(size), step):
        here = (term >= s) & (term < s + step) if len(size) > step else slice(None)
        grid = np.broadcast_to(floor, (min(step, len(size) - s), len(totals))).copy()
        grid[term[here] - s, source[here]] = p[here]
        for k in range(len(totals)):
            gap = grid[:, k, None] - grid
            sums[k] += (gap * gap // grid).sum(axis=0)
    above = np.flatnonzero(p > q)
    value = (p[above] - q[above]) ** 2 // q[above]
    order = np.lexsort((-value, source[above]))
    above, value = above[order], value[order]
    of = source[above]
    first = np.searchsorted(of, np.arange(len(totals)))
    last = np.minimum(first[of] + ranks - 1, np.searchsorted(of, of, "right") - 1)
    keep = value >= value[last]
    a, b = np.divmod(np.arange(len(totals) ** 2), len(totals))
    other = a != b
    digest, more = (rows.column(c).to_numpy()[term[above[keep]]] for c in ("digest", "more"))
    pairs = int(other.sum())
    return {
        "no": np.append(a[other], of[keep]), "other": np.append(b[other], np.full(keep.sum(), -1)), "digest": np.append(np.zeros(pairs, np.int64), digest),
        "more": np.append(np.zeros(pairs, np.int64), more), "value": np.append(sums[a[other], b[other]], value[keep]),
    }


def audit(df: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS, bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source against the others of its language, and its terms above it.

    Null texts, languages and sources count as empty. A term is a run of letters of ASCII, lower-cased, and of other
    characters. Repeated rows are documents of their own; texts of any length are looked at in stretches; ties go by the
    item's bytes; a language without kept terms has pairs of value 0 and no terms; an empty table gives no rows; other
    columns are not read. ``bits``: width of a digest; fewer make more terms share one, which changes no row.

    A term is one row for each task that has it, and of a group of terms only what can still be among the first goes on.
    Each two sources of a language are a row of the result; how many there are is all that grows with their square.
    """
    groups = numbered_sources(df)
    table = counted(df, groups, bits)
    plain, shared = kept_terms(table, least)
    found = occurrences(table, plain, shared)
    discard(table)
    sums = checkpointed(found.select("lang", F.inline(F.arrays_zip("sources", "counts"))).groupBy("lang", F.col("sources").alias("no")).agg(F.sum("counts").alias("n")))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("width")).join(found.groupBy("lang").agg(F.count("*").alias("terms")), "lang")
    whole = sums.groupBy("lang").agg(F.lit(-1).alias("no"), F.sum("n").alias("n"))
    every = groups.join(sums, ["lang", "no"], "left").select("lang", "no", F.coalesce("n", F.lit(0)).alias("n")).unionAll(whole)
    dealt = checkpointed(sizes.select("lang", "terms", F.ceil(F.col("terms") / F.greatest("width", F.lit(GROUP_TERMS))).cast("long").alias("deals")))
    header = every.join(dealt, "lang").select("lang", "no", (F.col("n") + F.col("terms")).alias("total"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    rows = found.join(dealt.select("lang", "deals"), "lang").withColumn("deal", F.pmod(F.xxhash64("digest", "more"), "deals")).drop("deals")

    def met(key: tuple, rows: pa.Table, header: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), **{n: pa.array([], pa.int64()) for n in ("no", "other", "digest", "more", "value")}})
        out = compared(rows, header, ranks)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out["no"]), pa.string()), **{n: pa.array(x) for n, x in out.items()}})

    schema = "lang string, no long, other long, digest long, more long, value long"
    both = checkpointed(rows.groupBy("lang", "deal").cogroup(header.groupBy("lang", "deal")).applyInArrow(met, schema))
    # pairs: a language without kept terms has them too
    named = groups.select("lang", F.col("no").cast("long").alias("no"), "source")
    others = named.select("lang", F.col("no").alias("other"), F.col("source").alias("item"))
    summed = both.where("other >= 0").groupBy("lang", "no", "other").agg(F.sum("value").alias("value"))
    pairs = named.join(others, "lang").where("no != other").join(summed, ["lang", "no", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    # terms: those that tie with the last rank stay until their text tells
    best = both.where("other < 0").withColumn("r", F.rank().over(Window.partitionBy("lang", "no").orderBy(F.desc("value")))).where(F.col("r") <= ranks).drop("r", "other")
    texts = plain.unionAll(shared).withColumn("more", F.col("more").cast("long"))
    terms = best.join(texts, ["lang", "digest", "more"]).join(named, ["lang", "no"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionAll(terms.withColumn("rank", place).where(F.col("rank") <= ranks))
