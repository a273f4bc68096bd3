"""Binary messages in the tag-length-value wire format of protocol buffers, read without their schema.

A message is a run of fields, each a key (number and wire type) and a value; names aren't written, so a field is
known by the numbers on the way to it. A length-delimited value is text if it is printable UTF-8, else a message if
all of it reads as one, else bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARINT, FIXED64, DELIMITED, FIXED32 = 0, 1, 2, 5
DEPTH = 16  # of messages in messages; what is deeper stays bytes
FIELDS = "path string, place int, wire int, number long, text string, bytes binary"
_BATCH = 10_000  # fields of a batch that a task hands on


def varint(data: bytes, at: int) -> tuple[int, int]:
    """The number whose groups of seven bits, lowest first, begin at ``at``, and the place behind it."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            break
        b = data[at + k]
        value |= (b & 0x7F) << (7 * k)
        if b < 0x80:
            if value >> 64:
                break
            return value, at + k + 1
    raise ValueError("no whole number")


def fields(data: bytes) -> tuple[list[tuple[int, int, int | bytes]], bool]:
    """(field number, wire type, value) of a message's fields up to the first that isn't whole, and whether all were."""
    out, at = [], 0
    while at < len(data):
        try:
            key, at = varint(data, at)
            number, wire = key >> 3, key & 7
            if not number:
                return out, False
            if wire == VARINT:
                value, at = varint(data, at)
            else:
                if wire == DELIMITED:
                    size, at = varint(data, at)
                else:
                    size = {FIXED64: 8, FIXED32: 4}.get(wire, -1)
                if size < 0 or at + size > len(data):
                    return out, False
                value, at = data[at : at + size], at + size
        except ValueError:
            return out, False
        out.append((number, wire, value))
    return out, True


def printable(data: bytes) -> str | None:
    """UTF-8 without control characters other than tab and line ends."""
    try:
        t = data.decode()
    except UnicodeDecodeError:
        return None
    return t if all(c.isprintable() or c in "\t\n\r" for c in t) else None


def walk(data: bytes, depth: int = DEPTH, path: str = "") -> Iterator[tuple[str, int, int, int | None, str | None, bytes | None]]:
    """(path, place, wire, number, text, bytes) of the values in a message and in those inside it; place counts the fields of one message.

    A message inside gives its own fields and no value. Fixed-width values are bytes and, read as unsigned, numbers.
    """
    for place, (number, wire, value) in enumerate(fields(data)[0]):
        own = f"{path}.{number}" if path else str(number)
        if wire == VARINT:
            yield own, place, wire, _signed(value), None, None
        elif wire != DELIMITED:
            yield own, place, wire, _signed(int.from_bytes(value, "little")), None, value
        elif (text := printable(value)) is not None:
            yield own, place, wire, None, text, value
        elif depth > 1 and fields(value)[1]:
            yield from walk(value, depth - 1, own)
        else:
            yield own, place, wire, None, None, value


def _signed(x: int) -> int:
    """64 bits as Spark's long has them."""
    return x - (1 << 64) if x >> 63 else x


def encoded(number: int, value: int | str | bytes) -> bytes:
    """One field: an integer as a varint, text and bytes with their length."""

    def whole(n: int) -> bytes:
        out, n = bytearray(), n & ((1 << 64) - 1)
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return whole(number << 3 | VARINT) + whole(value)
    data = value.encode() if isinstance(value, str) else value
    return whole(number << 3 | DELIMITED) + whole(len(data)) + data


def decoded(df: DataFrame, data: str, *keep: str, depth: int = DEPTH) -> DataFrame:
    """The fields of each row's message with the row's ``keep`` columns; null and empty messages have none.

    Broken ones give what comes before the break; ``complete`` tells them apart. A message is one task's work, its
    fields are handed on in batches.
    """
    types = dict(df.dtypes)
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, complete, out = [], [], []

            def made() -> pa.RecordBatch:
                kept = [b.column(k).take(pa.array(at)) for k in range(len(keep))]  # noqa: B023
                found = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, *found, pa.array(complete)], [*keep, "path", "place", "wire", "number", "text", "bytes", "complete"])  # noqa: B023

            for k, message in enumerate(b.column(len(keep))):
                if not (data := message.as_py()):
                    continue
                whole = fields(data)[1]
                for f in walk(data, depth):
                    at.append(k)
                    complete.append(whole)
                    out.append(f)
                    if len(out) >= _BATCH:
                        yield made()
                        at, complete, out = [], [], []
            if out:
                yield made()

    schema = "".join(f"`{k}` {types[k]}, " for k in keep) + FIELDS + ", complete boolean"
    return df.select(*keep, F.col(data).cast("binary")).mapInArrow(rows, schema)


def read(spark: SparkSession, path: str, glob: str = "*", depth: int = DEPTH) -> DataFrame:
    """(file, path, place, ..): the fields of files that hold a message each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return decoded(files.select(F.col("path").alias("file"), "content"), "content", "file", depth=depth)
