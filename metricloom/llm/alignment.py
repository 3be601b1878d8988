"""Two tokenizers' ids over the same bytes: which tokens overlap, and where both end.

The tokens of all documents of a block stand in flat arrays with their ends in bytes. One state vector holds a place among
A's tokens and one among B's for each lane, a stretch of a document between two common ends; every step links the two
tokens of each lane, moves the one that ends first, or both at a cut, and drops lanes that are done.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import checkpointed, extended

#: Bytes of text that are held as tokens at a time.
BLOCK_BYTES = 2_000_000
#: Words after which a lane ends: a long document is several lanes, so that no step waits for it alone.
LANE_WORDS = 1_000
#: Words that are kept with their tokens; then the store begins anew.
STORE_WORDS = 300_000

#: Unicode's white space. A word ends before it, but where a piece can hold it after something else.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Ids of A and of B in one number.
SHIFT = 32


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library; special tokens in a text are plain text."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        alphabet = byte_alphabet()
        size = self.own.get_vocab_size()
        self.data = [bytes(alphabet.get(c, 0) for c in self.own.id_to_token(i) or "") for i in range(size)]
        said = json.loads(self.own.to_str())
        split = said["pre_tokenizer"] or {}
        #: Whether words can be encoded one by one.
        self.by_words = said["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A ``sentencepiece`` model that puts a space before every text."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.data = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        plain = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (self.own.is_byte(i) or self.own.is_control(i) or self.own.is_unknown(i))]
        #: White space that a piece can hold after something else; for a space, after other than spaces.
        self.joined = {c for p in plain for c in re.findall(f"(?<=.)[{SPACE.replace(' ', '')}]|(?<=[^ ]) ", p, re.S)}
        self.by_words = " " not in self.joined
        self.space = self.own.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Each text begins with white space; a space is the one that the model adds, another one follows what it adds.

        The model adds none to an empty text, so a space alone is told here.
        """
        found = self.own.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [[self.space] if t == " " else ids if t[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for t, ids in zip(texts, found, strict=True)]


class Store(dict):
    """Words by number, with their tokens of both tokenizers as flat arrays; a word that is not there joins the next lot."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.sides, self.fresh = (a, b), []
        self.lengths = [np.array([len(x) for x in s.data], np.int64) for s in self.sides]
        more = f"(?:[{''.join(sorted(b.joined))}][{SPACE}]*[^{SPACE}]*)*" if b.joined else ""
        self.words = re.compile(f"[{SPACE}]*[^{SPACE}]+{more}|[{SPACE}]+").findall if a.by_words and b.by_words else lambda text: [text]
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.at = [np.zeros(1, np.int64) for _ in self.sides]
        self.ids = [np.zeros(0, np.int32) for _ in self.sides]
        self.same = np.zeros(0, bool)

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number

    def settle(self) -> None:
        """Encode the words that came since the last time."""
        if not self.fresh:
            return
        same = np.ones(len(self.fresh), bool)
        for k, side in enumerate(self.sides):
            found = side.encode(self.fresh)
            same &= np.array([b"".join(map(side.data.__getitem__, ids)) == w.encode() for w, ids in zip(self.fresh, found, strict=True)])
            self.at[k] = np.append(self.at[k], self.at[k][-1] + np.cumsum([len(x) for x in found]))
            self.ids[k] = np.append(self.ids[k], np.array([i for x in found for i in x], np.int32))
        self.same = np.append(self.same, same)
        self.fresh = []


@lru_cache(maxsize=2)
def store(a_path: str, b_path: str) -> Store:
    """One for each Python worker, from two files of a fixed size that every machine has."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Store(ByteLevel(a_path), Pieces(b_path))


def gathered(ids: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of words by their numbers, and how many each word has."""
    n = at[numbers + 1] - at[numbers]
    first = np.cumsum(n) - n
    return ids[np.repeat(at[numbers] - first, n) + np.arange(n.sum())], n


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as places among A's and B's tokens, and cuts in the same way: the last A and the last B token before each.

    Lane k holds A's tokens ``a_from[k]`` to ``a_to[k]`` and B's from ``b_from[k]`` on; both end at the same byte. All lanes
    go one step at a time.
    """
    made, cut = 0, 0
    links = np.empty((2, len(a_end) + len(b_end)), np.int32)
    cuts = np.empty((2, min(len(a_end), len(b_end))), np.int32)
    going = a_from < a_to
    i, j, stop = a_from[going], b_from[going], a_to[going]
    while len(i):
        n = len(i)
        links[0, made : made + n], links[1, made : made + n] = i, j
        made += n
        x, y = a_end[i], b_end[j]
        met = x == y
        k = int(np.count_nonzero(met))
        if k:
            cuts[0, cut : cut + k], cuts[1, cut : cut + k] = i[met], j[met]
            cut += k
        i, j = i + (x <= y), j + (y <= x)
        if k:  # only at a cut can a lane be done
            going = i < stop
            if not going.all():
                i, j, stop = i[going], j[going], stop[going]
    return links[0, :made], links[1, :made], cuts[0, :cut], cuts[1, :cut]


class Block:
    """The tokens of some documents, aligned. Documents without tokens have empty ranges."""

    def __init__(self, texts: list[str | None], known: Store):
        if len(known) > STORE_WORDS:
            known.clear()
        numbers, words = [], []
        for text in texts:
            found = known.words(f" {text}") if text else []
            numbers.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
            words.append(len(found))
        known.settle()
        n_words = np.array(words, np.int64)
        number = np.concatenate([*numbers, np.zeros(0, np.int64)])
        doc = np.repeat(np.arange(len(texts)), n_words)
        wrong = np.unique(doc[~known.same[number]])
        for d in wrong:  # bytes that differ within words differ in the text, unless it can be told that they don't
            data = [b"".join(s.data[i] for w in numbers[d] for i in ids[at[w] : at[w + 1]]) for s, ids, at in zip(known.sides, known.ids, known.at, strict=True)]
            if data[0] == data[1] == f" {texts[d]}".encode():
                wrong = wrong[wrong != d]
        kept = ~np.isin(doc, wrong)
        number, doc = number[kept], doc[kept]
        n_words[wrong] = 0
        starts = np.concatenate([np.arange(first, first + n, LANE_WORDS) for first, n in zip(np.cumsum(n_words) - n_words, n_words, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.ids, ends, places, self.of = [], [], [], []
        for ids, at, lengths in zip(known.ids, known.at, known.lengths, strict=True):
            own, n = gathered(ids, at, number)
            self.ids.append(own)
            ends.append(np.cumsum(lengths[own]))
            places.append(np.append(np.cumsum(n) - n, n.sum())[np.append(starts, len(number))].astype(np.int32))
            self.of.append(np.repeat(doc, n))
        if not known.same[number].all():  # a document whose words don't end together is one lane
            here = np.unique(doc)
            places = [np.append(np.searchsorted(of, here), len(of)).astype(np.int32) for of in self.of]
        self.n = [np.bincount(of, minlength=len(texts)) for of in self.of]
        self.ends = ends
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(ends[0], ends[1], places[0][:-1], places[0][1:], places[1][:-1])
        self.n_groups = np.bincount(self.of[0][self.cut_a], minlength=len(texts))

    def groups(self) -> list[bytes]:
        """Each document's ids, ``a1,a2|b1;a3|b2,b3``."""
        sizes = [len(x) for x in self.ids]
        last = [np.zeros(size, np.int64) for size in sizes]
        last[0][self.cut_a], last[1][self.cut_b] = 1, 1
        group = [np.cumsum(x) - x for x in last]
        counts = [np.bincount(g, minlength=len(self.cut_a)) for g in group]
        # before an A token stand the B tokens of the groups before, before a B token the A tokens up to its own
        earlier = [np.cumsum(counts[1]) - counts[1], np.cumsum(counts[0])]
        code = np.empty(sum(sizes), np.int32)
        for side in (0, 1):
            code[np.arange(sizes[side]) + earlier[side][group[side]]] = 3 * self.ids[side] + last[side] * (side + 1)
        digits, n = written(1 + int(code.max(initial=0)) // 3)
        n = n[code]
        text = digits[code][np.arange(digits.shape[1]) < n[:, None]].tobytes()
        stops = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(self.n[0] + self.n[1]))]
        return [text[s : e - 1] if e > s else b"" for s, e in zip(stops[:-1], stops[1:], strict=True)]


@lru_cache(maxsize=4)
def _written(most: int) -> tuple[np.ndarray, np.ndarray]:
    width = len(str(most)) + 1
    text = [b"%d%s" % (i, end) for i in range(most) for end in (b",", b"|", b";")]
    return np.array(text, f"S{width}").view(np.uint8).reshape(-1, width), np.array([len(x) for x in text])


def written(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids below ``most``, each followed by a comma, a bar or a semicolon, as rows of characters, and their lengths."""
    return _written(1 << max(10, (most - 1).bit_length()))


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts reach the bytes of a block."""
    for batch in batches:
        size = list(accumulate(x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()))
        start, past = 0, 0
        for i, total in enumerate(size):
            if total - past >= BLOCK_BYTES or i == len(size) - 1:
                yield batch.slice(start, i + 1 - start)
                start, past = i + 1, total


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def links(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, a_ids, b_ids, a_ends, b_ends, link_a, link_b, cut_a, cut_b``: the tokens of the space and the text with their
    ends in bytes, the places of the tokens of each link, and of the last ones before each cut, in order.

    A null or empty text has empty lists, and so has one whose tokens don't give back its bytes. Repeated rows, null keys
    and texts of any length are rows like others; other columns are not read; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    given = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    names = ("a_ids", "b_ids", "a_ends", "b_ends", "link_a", "link_b", "cut_a", "cut_b")
    schema = extended(given.select("k"), **{n: "array<long>" if n.endswith("ends") else "array<int>" for n in names})
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = store(a_path, b_path)
        for batch in blocks(batches, "t"):
            x = Block(batch.column("t").to_pylist(), known)
            before = [np.cumsum(n) - n for n in x.n]
            out = [lists(ids, n, pa.int32()) for ids, n in zip(x.ids, x.n, strict=True)]
            base = [np.append(0, e)[b] for e, b in zip(x.ends, before, strict=True)]
            out += [lists(e - s[o], n, pa.int64()) for e, s, o, n in zip(x.ends, base, x.of, x.n, strict=True)]
            for a, b in ((x.link_a, x.link_b), (x.cut_a, x.cut_b)):
                order = np.lexsort((b, a))
                of = x.of[0][a[order]]
                n = np.bincount(of, minlength=batch.num_rows)
                out += [lists(p[order] - s[of], n, pa.int32()) for p, s in zip((a, b), before, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *out], schema=fields)

    return given.mapInArrow(run, schema).withColumnRenamed("k", key)


def tables(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table of ``block, k, n_a, n_b, n_groups, n_links, groups_sha256, pairs, documents, which, times``.

    ``pairs`` (A's id above B's) and ``documents``, how many of the block's documents hold each, stand in the first row of a
    block only; ``which`` and ``times`` are a document's pairs by place there and how often it links them.
    """
    import hashlib

    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    given = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = extended(given.select(F.lit(0).cast("long").alias("block"), "k"), n_a="long", n_b="long", n_groups="long", n_links="long", groups_sha256="string", pairs="array<long>", documents="array<int>", which="array<int>", times="array<int>")
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = store(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "t"):
            rows = batch.num_rows
            x = Block(batch.column("t").to_pylist(), known)
            pair = x.ids[0][x.link_a].astype(np.int64) << SHIFT | x.ids[1][x.link_b]
            pairs, place = np.unique(pair, return_inverse=True)
            held, times = np.unique(x.of[0][x.link_a] * np.int64(max(1, len(pairs))) + place, return_counts=True)
            of, which = np.divmod(held, max(1, len(pairs)))
            documents = np.bincount(which, minlength=len(pairs))
            per_row = np.bincount(of, minlength=rows)
            first = [len(pairs)] + [0] * (rows - 1)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in x.groups()]
            n_links = np.bincount(x.of[0][x.link_a], minlength=rows)
            columns = [pa.array(np.full(rows, number)), batch.column("k"), *(pa.array(n.astype(np.int64)) for n in (x.n[0], x.n[1], x.n_groups, n_links)), pa.array(digests)]
            columns += [lists(pairs, first, pa.int64()), lists(documents, first, pa.int32()), lists(which, per_row, pa.int32()), lists(times, per_row, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)
            number += 1

    return checkpointed(given.mapInArrow(run, schema))


def pair_counts(table: DataFrame) -> DataFrame:
    """``a, pair, n, best``: in how many documents each pair is linked, and whether no other pair of its A id is in more.

    Blocks have summed their documents before, so the hottest pair is a row for each block.
    """
    from pyspark.sql import Window

    each = table.where("size(pairs) > 0").select(F.inline(F.arrays_zip("pairs", "documents"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("n"))
    own = Window.partitionBy("a")
    return each.withColumn("a", F.shiftright("pair", SHIFT)).withColumn("best", F.col("n") == F.max("n").over(own)).select("a", "pair", "n", "best")


def translations(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``a, b, n, best``: all id pairs that are linked anywhere, with the number of documents that link them."""
    found = pair_counts(tables(df, a_path, b_path, text, text))
    return found.select(F.col("a").cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int").alias("b"), "n", "best")


def digest(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A null or empty text, and one whose tokens don't give back its bytes, has zeros and an empty digest. Repeated rows
    count as documents of their own; null keys and texts of any length are rows like others; other columns are not read;
    an empty table gives no rows. Counts come back to blocks, one row for each pair of a block, and meet its documents
    there; a block is bounded by its bytes, or is one document.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    table = tables(df, a_path, b_path, key, text)
    asked = table.where("size(pairs) > 0").select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pair_counts(table), "pair").select(F.col("block").alias("of"), "place", "n", "best")
    docs = table.drop("pairs", "documents")
    schema = extended(docs.select("k", "n_a", "n_b", "n_groups", "n_links"), n_best="long", count_sum="long", groups_sha256="string")
    fields = to_arrow_schema(schema)

    def met(rows: pa.Table, found: pa.Table) -> pa.Table:
        count, best = np.zeros((2, found.num_rows), np.int64)
        place = found.column("place").to_numpy()
        count[place], best[place] = found.column("n").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        rows = rows.combine_chunks()
        which, times = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("which", "times"))
        stops = np.append(0, np.cumsum(which.value_lengths().to_numpy()))
        which, times = which.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        sums = []
        for value in (best, count):
            running = np.append(0, np.cumsum(value[which] * times))[stops]
            sums.append(pa.array(np.diff(running)))
        plain = [rows.column(c) for c in ("k", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*plain, *sums, rows.column("groups_sha256")], schema=fields)

    return docs.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(met, schema).withColumnRenamed("k", key)
