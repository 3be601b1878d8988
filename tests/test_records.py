"""Record files written byte by byte."""

import gzip
import random
import struct

import pytest

from metricloom.sources.records import BLOCK, frames, read_records


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def example(**given):
    body = b""
    for name, values in given.items():
        if isinstance(values[0], float):
            kind = part(2, part(1, struct.pack(f"<{len(values)}f", *values)))
        elif isinstance(values[0], int):
            kind = part(3, part(1, b"".join(map(varint, values)))) if name != "loose" else part(3, b"".join(varint(8) + varint(v) for v in values))
        else:
            kind = part(1, b"".join(part(1, v.encode()) for v in values))
        body += part(1, part(1, name.encode()) + part(2, kind))
    message = part(1, body)
    return struct.pack("<Q", len(message)) + b"crc." + message + b"crc."


def test_records(spark, tmp_path):
    data = example(age=[13, -5], score=[0.5, 1.5], tags=["é", "b"]) + example(age=[7]) + example(loose=[3, 4], tags=["x"])
    (tmp_path / "a.rec").write_bytes(data)
    (tmp_path / "b.rec").write_bytes(gzip.compress(example(score=[2.0])))
    (tmp_path / "c.rec").write_bytes(b"")
    rows = read_records(spark, str(tmp_path), "age bigint, ages array<bigint>, score double, tags array<string>, loose array<bigint>")
    got = [(r.age or 0, r.score, r.tags, r.loose) for r in rows.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(13, 0.5, ["é", "b"], None), (7, None, None, None), (0, None, ["x"], [3, 4]), (0, 2.0, None, None)]))
    (tmp_path / "a.rec").write_bytes(data[:-3])
    with pytest.raises(Exception, match="ends within"):
        rows.collect()


def test_gzip_members_are_all_read():
    messages = [bytes([i]) * n for i, n in enumerate([5, 0, 3 * BLOCK, 70, BLOCK - 16, 9])] + [random.Random(1).randbytes(3 * BLOCK)]
    framed = [struct.pack("<Q", len(m)) + b"crc." + m + b"crc." for m in messages]
    assert list(frames(b"".join(map(gzip.compress, framed)))) == messages
    whole = b"".join(framed)
    for cut in (7, BLOCK, BLOCK + 33):  # members end within messages
        parts = gzip.compress(whole[:cut]), gzip.compress(whole[cut:])
        assert list(frames(b"".join(parts))) == list(frames(bytes(600).join(parts) + bytes(9))) == messages
    with pytest.raises(ValueError, match="ends within"):
        list(frames(gzip.compress(whole)[:-5]))
    with pytest.raises(ValueError, match="ends within a message"):
        list(frames(gzip.compress(whole[:-2])))
