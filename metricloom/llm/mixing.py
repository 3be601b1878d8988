"""A mix of sources in which each has its target of words: weighted fair queueing over shuffled documents.

A source's documents stand in a shuffled order and, where its target asks for it, again after the last one. Each has a
virtual finish time, the source's words up to its end divided by the source's target; the mix is all sources' documents by
that time, up to the budget.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import checkpointed, discard

#: How often a source, and so each of its documents, may be taken at most.
TIMES = 3
#: Weights of the sources by code point, over and over; words of one unit where a document is under way at its source's target.
WEIGHTS, RUN = (1, 2, 3), 64


def words(text: Column) -> Column:
    """Runs of characters other than white space of ASCII; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: Sequence[Column], value: str, group: str | None = None) -> DataFrame:
    """A written table of the columns and ``before``: the sum of ``value`` over earlier rows, of the same group if there is one.

    Rows are dealt out by ranges of the order, which begins with the group, and sorted there; each range is summed along,
    then the sums of whole ranges are added, a row for each range and group. A hot group is many ranges. Values are whole
    numbers, so the sums are exact whatever the ranges are; rows that tie in the order may stand in any order.
    """
    of = F.col(group) if group else F.lit(None).cast("string")
    placed = df.withColumn("__of", of).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    schema = placed.withColumn("before", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(value).to_numpy(zero_copy_only=False)
            of = batch.column("__of").dictionary_encode(null_encoding="encode")
            code = of.indices.to_numpy(zero_copy_only=False)
            first = np.append(True, np.diff(code) != 0)
            heads = np.flatnonzero(first)
            before = np.cumsum(n) - n
            base = before[heads]
            names = of.dictionary.take(pa.array(code[heads])).to_pylist()
            if last is not None and names[0] == last[0]:
                base[0] -= carried
            before -= base[np.cumsum(first) - 1]
            last, carried = (names[-1],), int(before[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=schema.names)

    local = checkpointed(placed.mapInArrow(run, schema))
    parts = local.groupBy("__of", "__part").agg(F.sum(value).alias("__n"))
    earlier = Window.partitionBy("__of").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__earlier", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).select(F.col("__of").alias("__o"), F.col("__part").alias("__p"), "__earlier")
    joined = local.join(offsets, F.col("__of").eqNullSafe(F.col("__o")) & (F.col("__part") == F.col("__p")))
    out = checkpointed(joined.withColumn("before", F.col("before") + F.col("__earlier")).select(*df.columns, "before"))
    discard(local)
    return out


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, times: int = TIMES, budget: int | None = None) -> DataFrame:
    """A written table ``source, source_size, weight, target`` from ``source, source_size``.

    Sources by code point, null last, have the weights in turn and share the budget (all words) by them; a target stops at
    ``times`` its source's size, and the rest is shared again by weight among the others until none is above. A budget
    above ``times`` all words is ``times`` all words. Whole numbers and ratios of them decide who is above.
    """
    if budget is not None and budget < 0 or not weights or min(weights) <= 0:
        raise ValueError("weights are above 0 and a budget is not below")
    order = [F.col("source").asc_nulls_last()]
    ranked = running(sizes.withColumn("__one", F.lit(1).cast("long")), order, "__one")
    turn = F.element_at(F.lit(list(weights)).cast("array<long>"), (F.pmod("before", F.lit(len(weights))) + 1).cast("int"))
    table = checkpointed(ranked.select("source", "source_size", turn.alias("weight")))
    discard(ranked)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget = total if budget is None else min(budget, times * total)
    # the level: words for each weight of sources that are not at their most
    free, weight, full = budget, None, -1
    most = F.col("source_size").cast("decimal(38,0)") * times
    at_most = F.lit(False)
    while True:
        row = table.agg(F.sum(F.when(at_most, most)).alias("used"), F.sum(F.when(~at_most, F.col("weight"))).alias("weight"), F.count(F.when(at_most, 1)).alias("full")).first()
        if row.full == full:
            break
        full, free, weight = row.full, budget - int(row.used or 0), row.weight
        if not weight:
            break
        at_most = most * F.lit(weight) <= F.col("weight").cast("decimal(38,0)") * F.lit(free)
    level = (F.col("weight") * F.lit(float(free))) / F.lit(float(weight)) if weight else F.lit(0.0)
    return checkpointed(table.select("source", "source_size", "weight", F.when(at_most, (F.col("source_size") * times).cast("double")).otherwise(level).alias("target")))


def shuffled(seed: str, key: Column) -> Column:
    """Places of documents in a shuffled order: 60 bits of the MD5 of the seed and the key's text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def queued(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, times: int = TIMES, budget: int | None = None, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Two written tables: the documents, ``row, key, source, size, source_size, target, before``, and the units of the mix.

    A unit, ``row, copy, finish, source, place, words, first``, is a document with words that ends before its source's
    target, or 64 words of the one that is under way there; later ones never come. ``before`` are the source's words in
    front of the document in its shuffled order.
    """
    docs = df.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), shuffled(seed, F.col(key)).alias("place"), F.md5(F.coalesce(text, F.lit(""))).alias("tie"))
    docs = checkpointed(docs.withColumn("row", F.monotonically_increasing_id()))
    wanted = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, times, budget)
    order = [F.col("source").asc_nulls_last(), "place", F.col("key").asc_nulls_last(), "tie"]
    placed = running(docs, order, "size", "source")
    discard(docs)
    by = wanted.select(F.col("source").alias("__source"), "source_size", "target")
    placed = checkpointed(placed.join(by, F.col("source").eqNullSafe(F.col("__source"))).select("row", "key", "source", "place", "tie", "size", "source_size", "target", "before"))
    copies = placed.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("copy")).withColumn("start", F.col("before") + F.col("copy") * F.col("source_size")).where("start < target")
    runs = F.when(F.col("start") + F.col("size") <= F.col("target"), F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("words")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("size") - 1, F.ceil(F.col("target") - F.col("start")) - 1), F.lit(RUN).cast("long")), lambda i: F.struct(i.alias("first"), F.least(F.lit(RUN), F.col("size") - i).cast("long").alias("words")))
    )
    units = copies.select("row", "key", "tie", "copy", "source", "place", "start", "target", F.inline(runs))
    return placed, units.select("row", "key", "tie", "copy", ((F.col("start") + F.col("first") + F.col("words")) / F.col("target")).alias("finish"), "source", "place", "words", "first")


def stream(units: DataFrame, budget: int) -> DataFrame:
    """A written table of the mix in order: the units with ``before``, the mix's words in front of each, and ``taken``, the words
    of it within the budget."""
    order = ["finish", F.col("source").asc_nulls_last(), "place", F.col("key").asc_nulls_last(), "tie", "copy", "first"]
    inside = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.lit(budget).cast("long") - F.col("before")))
    return running(units, order, "words").withColumn("taken", inside).where("taken > 0")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, times: int = TIMES, budget: int | None = None, seed: str = "mix") -> DataFrame:
    """A row for each row: ``key, size, source_size, target, taken``, the words that the mix takes of it, repeats counted.

    A null text has no words and is never taken; null keys come last in their place, and repeated rows follow each other.
    Sources are compared by code point, null last and a source of its own. Rows that are equal in key and text share what
    is taken in any way, all else depends on the rows alone, not on how they are dealt out. A table without words has
    targets of 0; an empty table gives no rows; other columns are not read.
    """
    placed, units = queued(df, key, text, source, weights, times, budget, seed)
    if budget is None:
        budget = placed.agg(F.sum("size")).first()[0] or 0
    taken = stream(units, budget).groupBy(F.col("row").alias("__row")).agg(F.sum("taken").alias("taken"))
    out = placed.join(taken, F.col("row") == F.col("__row"), "left")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
