"""JP2 boxes: a file as rows of boxes, and the few boxes whose content matters."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import ByteReader, Truncated, big_endian

#: Box types that are recognised (fixed values); those of SUPER hold boxes themselves.
NAMES = {
    "jP  ": "signature",
    "ftyp": "file type",
    "jp2h": "header",
    "jp2c": "codestream",
    "jp2i": "intellectual property",
    "xml ": "xml",
    "uuid": "uuid",
    "uinf": "uuid info",
    "ihdr": "image header",
    "colr": "colour",
    "bpcc": "bits per component",
    "pclr": "palette",
    "cmap": "component mapping",
    "cdef": "channel definition",
    "res ": "resolution",
    "resc": "capture resolution",
    "resd": "display resolution",
    "ulst": "uuid list",
    "url ": "url",
}
SUPER = {"jp2h", "res ", "uinf"}
SIGNATURE = bytes.fromhex("0D0A870A")
#: Brand and compatibility entries of a file type box that are accepted.
BRAND, COMPATIBLE = "jp2 ", {"J2P0", "J2P1", "jp2 "}


def parse(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, str, int, bytes]]:
    """(depth, type, offset, content) of every box, parents first. Length 0 runs to the end, 1 means a 64-bit length."""
    reader = ByteReader(data, at, end)
    while reader.left():
        start = reader.at
        length, kind = reader.uint(4), reader.take(4).decode("latin-1")
        if length == 1:
            length = reader.uint(8)
        elif length == 0:
            length = reader.end - start
        content = reader.take(length - (reader.at - start))
        yield depth, kind, start, content
        if kind in SUPER:
            yield from parse(data, reader.at - len(content), reader.at, depth + 1)


def box(kind: str, content: bytes, long: bool = False) -> bytes:
    if long:
        return struct.pack(">I4sQ", 1, kind.encode("latin-1"), len(content) + 16) + content
    return struct.pack(">I4s", len(content) + 8, kind.encode("latin-1")) + content


def file_type(content: bytes) -> dict:
    """Brand, minor version and compatibility list; ValueError for another brand or version, or no known entry."""
    reader = ByteReader(content)
    brand, minor = reader.take(4).decode("latin-1"), reader.uint(4)
    entries = [reader.take(4).decode("latin-1") for _ in range(reader.left() // 4)]
    if brand != BRAND or minor != 0 or not COMPATIBLE & set(entries):
        raise ValueError(f"file type {brand!r}, version {minor}, {entries}")
    return {"brand": brand, "minor": minor, "compatible": entries}


def image_header(content: bytes) -> dict:
    height, width, components, depth, compression, unknown, rights = struct.unpack(">IIHBBBB", content[:14])
    if compression != 7:
        raise ValueError(f"compression {compression}")
    return {"height": height, "width": width, "components": components, "bits": (depth & 127) + 1, "signed": bool(depth & 128), "colour_unknown": bool(unknown), "rights": bool(rights)}


def codestream(data: bytes) -> bytes:
    """The codestream of a JP2 file, whose boxes are checked, or the bytes themselves if they are one."""
    if data[:2] == b"\xff\x4f":
        return data
    found = list(parse(data))
    top = [b for b in found if b[0] == 0]
    if not top or top[0][1] != "jP  " or top[0][3] != SIGNATURE:
        raise ValueError("neither a codestream nor a JP2 signature")
    if len(top) < 2 or top[1][1] != "ftyp":
        raise ValueError("no file type box")
    file_type(top[1][3])
    at = next((k for k, b in enumerate(found) if b[1] == "jp2h"), None)
    if at is None or at + 1 >= len(found) or found[at + 1][:2] != (1, "ihdr"):
        raise ValueError("no image header")
    image_header(found[at + 1][3])
    stream = next((b[3] for b in found if b[1] == "jp2c"), None)
    if stream is None:
        raise ValueError("no codestream box")
    return stream


def boxes(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """A row per box of each file (as `binaryFile` reads them): seq, depth, type, name, offset, length, payload.

    A file that ends within a box, or that isn't made of boxes, gives the boxes before that and a row
    with `error` set. A superbox has no payload; its boxes follow. Null content gives no row.
    """

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, error = [], None
                if data.as_py() is None:
                    continue
                try:
                    for depth, kind, at, body in parse(data.as_py()):
                        rows.append((depth, kind, NAMES.get(kind), at, len(body), None if kind in SUPER else body, None))
                except Truncated as e:
                    error = str(e)
                    rows.append((0, None, None, None, None, None, error))
                names = ["depth", "type", "name", "offset", "length", "payload", "error"]
                types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), batch.column(0).type), pa.array(range(len(rows)), pa.int32()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[key, "seq", *names])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"{key} {kind}, seq int, depth int, type string, name string, offset long, length long, payload binary, error string")


def image_headers(rows: DataFrame, key: str = "path") -> DataFrame:
    """Image headers of box rows, by projection."""

    def field(at: int, size: int) -> Column:
        return big_endian(F.col("payload"), at, size)

    return rows.filter("type = 'ihdr'").select(
        key,
        field(0, 4).alias("height"),
        field(4, 4).alias("width"),
        field(8, 2).cast("int").alias("components"),
        (field(10, 1).bitwiseAND(127) + 1).cast("int").alias("bits"),
        (field(10, 1).bitwiseAND(128) > 0).alias("signed"),
        (field(11, 1) == 7).alias("known_compression"),
    )
