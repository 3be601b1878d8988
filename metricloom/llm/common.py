"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, folds: int = 5) -> Column:
    """crc32 of the key's decimal text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")).cast("string").cast("binary")) % folds


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


#: Rows that are Python objects at a time: batches come larger, their rows as Arrow only.
ROWS = 1_000


def slices_of(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = ROWS) -> DataFrame:
    """``mapInArrow`` with a function call for so many rows; its dict becomes a batch of the schema's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, rows):
            yield record(fn(batch), fields)

    return df.mapInArrow(run, schema)


def record(columns: dict, fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == f.type else (x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)) for f, x in ((f, columns[f.name]) for f in fields)], schema=fields)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines of a cluster share.

    Only where it is unset and Spark runs in one process, as in tests, a folder of our own stands for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are computed once, written to a table in the shared folder and read from there.

    What a frame makes of places in a scan, such as row numbers, is fixed by that, whatever executors come or go later.
    Columns stand under numbers in the table, so any names are allowed. Tables stay in a folder named after the application.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    numbered.write.option("compression", "zstd").parquet(path)
    return _kept(spark.read.schema(numbered.schema).parquet(path).toDF(*df.columns), path)


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """Like ``checkpointed``, with a file for each of as many hashes of ``by`` as there are shuffle partitions.

    Joins and groupings on ``by`` bring the other side to these files and leave the rows where they are.
    """
    spark = df.sparkSession
    path, name = _new_path(spark), f"kept_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name only: the files lie outside the warehouse and stay
    return _kept(out, path)


def _new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.kept_in = path
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``checkpointed`` or ``bucketed`` that no later plan reads.

    Spark deletes the shuffle files of plans that are gone when the driver collects its garbage, so it is told to, also
    if there is no table to delete.
    """
    context = SparkSession.active().sparkContext
    for df in tables:
        path = context._jvm.org.apache.hadoop.fs.Path(df.kept_in)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    context._jvm.System.gc()


def extended(df: DataFrame, **kinds: str):
    """Schema of the frame's columns and of new ones."""
    return df.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in kinds.items())).schema
