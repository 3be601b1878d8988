"""Record files of serialised examples: length-framed messages, each a map from feature to a list of bytes, floats or
integers. A file is read by one task, for its frames tell only in order where the next one begins."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegralType, MapType, NumericType, StringType, StructType


#: Compressed bytes taken and bytes made at a time.
BLOCK = 1 << 20


def _inflated(data: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold, one member after another, a block at a time; zero bytes between are passed."""
    member, started = zlib.decompressobj(31), False
    for at in range(0, len(data), BLOCK):
        rest = data[at : at + BLOCK]
        while rest or not member.eof:
            if not started and not (rest := rest.lstrip(b"\0")):
                break
            started = True
            block = member.decompress(rest, BLOCK)
            if block:
                yield block
            rest = member.unconsumed_tail
            if member.eof:
                rest, member, started = member.unused_data, zlib.decompressobj(31), False
            elif not rest and len(block) < BLOCK:
                break
    if started:
        raise ValueError("a record file ends within a gzip member")


def frames(data: bytes) -> Iterator[bytes]:
    """Messages of a file: eight bytes of length, four of a checksum, the message, four of a checksum."""
    held, at = b"", 0
    for block in _inflated(data) if data[:2] == b"\x1f\x8b" else (data,):
        held, at = held[at:] + block, 0
        while at + 12 <= len(held):
            (size,) = struct.unpack_from("<Q", held, at)
            if at + 16 + size > len(held):
                break
            yield held[at + 12 : at + 12 + size]
            at += 16 + size
    if at < len(held):
        raise ValueError("a record file ends within a " + ("frame" if at + 12 > len(held) else "message"))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message; fixed-width ones as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


def _list(kind: int, data: bytes) -> list:
    out: list = []
    for _, value in fields(data):
        if kind == 1:
            out.append(value)
        elif kind == 2:
            out += struct.unpack(f"<{len(value) // 4}f", value)
        elif isinstance(value, int):
            out.append(value - (1 << 64) if value >> 63 else value)
        else:
            at = 0
            while at < len(value):
                x, at = _varint(value, at)
                out.append(x - (1 << 64) if x >> 63 else x)
    return out


def features(message: bytes) -> dict[str, list]:
    """Values by feature: bytes, floats or integers."""
    out = {}
    for number, body in fields(message):
        if number == 1:
            for _, entry in fields(body):
                parts = dict(fields(entry))
                out[parts.get(1, b"").decode()] = next((_list(k, v) for k, v in fields(parts.get(2, b""))), [])
    return out


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Examples with the columns of ``schema``: arrays get all values, other columns the first; a missing feature is null.

    A file's bytes as they are stored are in one task's memory, at most 2 GB; what gzip files hold is not.
    """
    shape = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                held: list[dict] = []
                for message in frames(data):
                    held.append(features(message))
                    if len(held) == 10_000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        columns = []
        for f in arrow:
            many = pa.types.is_list(f.type)
            text = pa.types.is_string(f.type.value_type if many else f.type)
            values = [r.get(f.name) for r in rows]
            if text:
                values = [None if v is None else [x.decode() for x in v] for v in values]
            columns.append(pa.array(values if many else [v[0] if v else None for v in values], f.type))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, shape)


# --- written ----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _castagnoli() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


def checksum(data: bytes) -> int:
    """The checksum of a frame: CRC-32C, turned by 15 bits, with a constant added."""
    crc, table = 0xFFFFFFFF, _castagnoli()
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(message: bytes) -> bytes:
    size = struct.pack("<Q", len(message))
    return size + struct.pack("<I", checksum(size)) + message + struct.pack("<I", checksum(message))


def _number(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _part(number: int, body: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(body)) + body


def message(values: dict[str, list]) -> bytes:
    """A message of features; a feature has texts or bytes, floats or integers."""
    body = b""
    for name, own in values.items():
        if own and isinstance(own[0], float):
            kind = _part(2, _part(1, struct.pack(f"<{len(own)}f", *own)))
        elif own and isinstance(own[0], int):
            kind = _part(3, _part(1, b"".join(map(_number, own))))
        else:
            kind = _part(1, b"".join(_part(1, x.encode() if isinstance(x, str) else bytes(x)) for x in own))
        body += _part(1, _part(1, name.encode()) + _part(2, kind))
    return _part(1, body)


@dataclass
class Written(WriterCommitMessage):
    """A task's file, where it stands until the job is done, and how many rows it has."""

    file: str
    rows: int


class RecordWriter(DataSourceWriter):
    """Each task writes a file into a folder of the job's own; only those that the job's end names come to be seen."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        store, base = self._store()
        context = TaskContext.get()
        name = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.rec"
        store.create_dir(f"{base}/_temporary/{self.job}", recursive=True)
        rows = 0
        with store.open_output_stream(f"{base}/_temporary/{self.job}/{name}") as out:
            for row in iterator:
                given = {n: v if isinstance(v, list) else [v] for n, v in row.asDict().items() if v is not None}
                out.write(framed(message({n: [int(x) if isinstance(x, bool) else x for x in v] for n, v in given.items()})))
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, base = self._store()
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(base, recursive=False)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for done in messages:
            if done is not None and done.rows:
                store.move(f"{base}/_temporary/{self.job}/{done.file}", f"{base}/{done.file}")
        self._gone(store, base)

    def abort(self, messages: list) -> None:
        self._gone(*self._store())

    def _gone(self, store, base: str) -> None:
        """What other attempts left goes with the job's folder."""
        from pyarrow import fs

        if store.get_file_info(f"{base}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_temporary/{self.job}")
        if not store.get_file_info(fs.FileSelector(f"{base}/_temporary", allow_not_found=True)):
            store.delete_dir(f"{base}/_temporary")


class ExampleRecords(DataSource):
    """The format ``example_records``: rows of numbers, texts, bytes and lists of them as record files."""

    @classmethod
    def name(cls) -> str:
        return "example_records"

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite)


def flat(df: DataFrame) -> DataFrame:
    """The columns as features can hold them: structs, maps and lists of these as JSON, times as text, small numbers wider."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        inner = kind.elementType if isinstance(kind, ArrayType) else kind
        if isinstance(inner, StructType | MapType | ArrayType):
            c = F.to_json(c)
        elif not isinstance(inner, StringType | BinaryType):
            whole = "long" if isinstance(inner, IntegralType | BooleanType) else "double" if isinstance(inner, NumericType) else "string"
            c = c.cast(f"array<{whole}>" if isinstance(kind, ArrayType) else whole)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_records(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows as record files that ``read_records`` reads: a file for each task with rows, all of them or none.

    Floating numbers keep 32 bits, as the form has them; a null is a missing feature.
    """
    df.sparkSession.dataSource.register(ExampleRecords)
    flat(df).write.format("example_records").mode("overwrite" if overwrite else "append").save(path)
