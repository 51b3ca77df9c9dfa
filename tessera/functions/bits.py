"""Bytes and bits: as columns over BINARY, and as cursors for bit-serial parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_at(data: Column, index: Column | int) -> Column:
    """Unsigned byte of a BINARY column. A slice of BINARY costs the same wherever it lies."""
    index = F.lit(index) if isinstance(index, int) else index
    return F.conv(F.hex(F.substring(data, index + 1, F.lit(1))), 16, 10).cast("int")


def bytes_of(data: Column) -> Column:
    """All bytes as an array; empty for no bytes, null for null."""
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), F.octet_length(data) - 1)).when(data.isNotNull(), F.array().cast("array<int>"))
    return F.transform(places, lambda i: byte_at(data, i))


def explode_bytes(rows: DataFrame, keys: list[str], data: str) -> DataFrame:
    """keys, i and b of every byte of a BINARY column; rows without bytes go.

    Six bytes are cut out at a time, as a number that no longer drags the whole value along.
    """
    size = F.octet_length(data)
    words = rows.filter(size > 0).select(*keys, data, F.explode(F.sequence(F.lit(0), F.floor((size - 1) / 6).cast("int"))).alias("_w"))
    part = F.substring(F.col(data), F.col("_w") * 6 + 1, F.lit(6))
    words = words.select(*keys, "_w", F.octet_length(part).alias("_n"), F.conv(F.hex(part), 16, 10).cast("long").alias("_v"))
    each = words.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return each.select(*keys, (F.col("_w") * 6 + F.col("_j")).alias("i"), F.expr("cast(shiftright(_v, 8 * (_n - 1 - _j)) & 255 as int)").alias("b"))


def big_endian(data: Column, offset: Column | int, size: int) -> Column:
    """Unsigned big-endian integer of up to 7 bytes; null where the bytes end early."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substring(data, offset + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def big_endian_bytes(value: Column, size: int) -> Column:
    """The reverse: BINARY of `size` bytes, upper bytes cut off."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 2 * size, "0"), F.lit(2 * size)))


def floor_log2(n: Column) -> Column:
    """Exact floor(log2 n) of a positive integer."""
    return (F.length(F.bin(n.cast("long"))) - 1).cast("int")


def ceil_div(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return F.floor((a + b - 1) / b).cast("long")


def comma_code(bits: Column) -> Column:
    """Leading ones of a bit string that a zero ends; null if none does."""
    at = F.instr(bits, "0")
    return F.when(at > 0, at - 1)


def pass_count(bits: Column) -> Column:
    """Number of coding passes that the start of a bit string codes."""

    def number(start: int, size: int) -> Column:
        return F.conv(F.substring(bits, start, size), 2, 10).cast("int")

    return (
        F.when(F.substring(bits, 1, 1) == "0", 1)
        .when(F.substring(bits, 1, 2) == "10", 2)
        .when(F.substring(bits, 1, 4) != "1111", 3 + number(3, 2))
        .when(F.substring(bits, 1, 9) != "111111111", 6 + number(5, 5))
        .otherwise(37 + number(10, 7))
    )


def pass_code(n: Column) -> Column:
    """The bit string of a number of coding passes from 1 to 164."""

    def digits(value: Column, size: int) -> Column:
        return F.lpad(F.bin(value.cast("long")), size, "0")

    return F.when(n == 1, "0").when(n == 2, "10").when(n <= 5, F.concat(F.lit("11"), digits(n - 3, 2))).when(n <= 36, F.concat(F.lit("1111"), digits(n - 6, 5))).otherwise(F.concat(F.lit("1" * 9), digits(n - 37, 7)))


def unstuffed_bits(data: Column) -> Column:
    """Bit string of packet-header bytes: a byte after 0xFF gives its lower 7 bits."""
    from tessera.functions.let import let

    def text(b: Column) -> Column:
        return F.array_join(F.transform(b, lambda x, i: F.when((i > 0) & (b[F.greatest(i - 1, F.lit(0))] == 255), F.lpad(F.bin(x.bitwiseAND(127).cast("long")), 7, "0")).otherwise(F.lpad(F.bin(x.cast("long")), 8, "0"))), "")

    return let(bytes_of(data), text)


class Truncated(ValueError):
    """The bytes end before what is being read does."""


class ByteReader:
    """Cursor over big-endian bytes; reading past the end raises."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def left(self) -> int:
        return self.end - self.at

    def take(self, size: int) -> bytes:
        if size < 0 or self.at + size > self.end:
            raise Truncated(f"{size} bytes at {self.at} of {self.end}")
        self.at += size
        return self.data[self.at - size : self.at]

    def uint(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")

    def peek(self) -> int:
        """The next two bytes as a marker, or -1 at the end."""
        return int.from_bytes(self.data[self.at : self.at + 2], "big") if self.left() >= 2 else -1


class BitReader:
    """Bits of packet headers: after 0xFF a byte holds 7."""

    def __init__(self, source: ByteReader):
        self.source, self.byte, self.left = source, 0, 0

    def bit(self) -> int:
        if not self.left:
            self.left = 7 if self.byte == 0xFF else 8
            self.byte = self.source.uint(1)
        self.left -= 1
        return self.byte >> self.left & 1

    def bits(self, count: int) -> int:
        value = 0
        for _ in range(count):
            value = value << 1 | self.bit()
        return value

    def ones(self) -> int:
        n = 0
        while self.bit():
            n += 1
        return n

    def passes(self) -> int:
        if not self.bit():
            return 1
        if not self.bit():
            return 2
        for base, size in ((3, 2), (6, 5), (37, 7)):
            value = self.bits(size)
            if value != (1 << size) - 1 or base == 37:
                return base + value
        raise AssertionError

    def align(self) -> None:
        """Back to whole bytes; a byte after 0xFF holds a stuffed bit and goes too."""
        if self.byte == 0xFF:
            self.source.take(1)
        self.byte = self.left = 0


class BitWriter:
    """The reverse of BitReader."""

    def __init__(self):
        self.out, self.byte, self.free = bytearray(), 0, 8

    def bit(self, value: int) -> None:
        self.free -= 1
        self.byte |= (value & 1) << self.free
        if not self.free:
            self._flush()

    def _flush(self) -> None:
        self.out.append(self.byte)
        self.free, self.byte = (7 if self.byte == 0xFF else 8), 0

    def bits(self, value: int, count: int) -> None:
        for k in reversed(range(count)):
            self.bit(value >> k)

    def ones(self, count: int) -> None:
        for _ in range(count):
            self.bit(1)
        self.bit(0)

    def passes(self, n: int) -> None:
        for low, high, prefix, size, width in ((1, 1, 0, 1, 0), (2, 2, 0b10, 2, 0), (3, 5, 0b11, 2, 2), (6, 36, 0b1111, 4, 5), (37, 164, 0b111111111, 9, 7)):
            if low <= n <= high:
                self.bits(prefix, size)
                self.bits(n - low, width)
                return
        raise ValueError(f"{n} passes")

    def done(self) -> bytes:
        """All bytes; one after 0xFF is always written, stuffed if need be."""
        if self.free != 8:
            self._flush()
            if self.free == 7:
                self._flush()
        return bytes(self.out)
