"""Exact deduplication through counting quotient filters.

A text is normalised (ASCII white space deleted) and fingerprinted to 64 bits. Each task builds, for
each range of fingerprints, a quotient filter with counts: a bit for every quotient that occurs, a bit
at the end of every run, and the sorted remainders with their counts, from which fingerprints are
recovered exactly. Filters of a range merge by their sorted remainders, without loss. Only rows whose
fingerprint has a merged count above one go on to the comparison of bytes; all others are single. The
number of ranges follows the number of rows, so that a merged filter stays at about `PRINTS` of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Up to so many fingerprints with a count above one are broadcast (8 bytes each); beyond, they are joined.
BROADCAST_FINGERPRINTS = 1 << 21
#: Fingerprints of a merged filter, about, and of a task that builds filters.
PRINTS = 1 << 20


class QuotientFilter:
    """A static counting quotient filter over 64-bit fingerprints with `low` bits of remainder."""

    def __init__(self, low: int, occupied: np.ndarray, runends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.low, self.occupied, self.runends, self.remainders, self.counts = low, occupied, runends, remainders, counts

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray | None = None, skip: int = 0):
        """From fingerprints that agree in their `skip` upper bits; equal ones add up."""
        keys, place = np.unique(prints.astype(np.uint64), return_inverse=True)
        sums = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64) if counts is None else _add(place, counts, len(keys))
        quotient_bits = min(64 - skip - 1, max(1, int(len(keys)).bit_length()))
        low = 64 - skip - quotient_bits
        quotients = (keys >> np.uint64(low)) & np.uint64((1 << quotient_bits) - 1)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients.astype(np.int64)] = True
        runends = np.append(quotients[1:] != quotients[:-1], [True]) if len(keys) else np.zeros(0, bool)
        return cls(low, occupied, runends, keys & np.uint64((1 << low) - 1), sums)

    def fingerprints(self, prefix: int = 0, skip: int = 0) -> np.ndarray:
        """All fingerprints, sorted: the k-th run belongs to the k-th occupied quotient."""
        runs = np.concatenate([[0], np.cumsum(self.runends)[:-1]]).astype(np.int64) if len(self.runends) else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[runs]
        high = np.uint64(prefix << (64 - skip)) if skip else np.uint64(0)
        return high | (quotients << np.uint64(self.low)) | self.remainders

    def pack(self) -> bytes:
        head = np.array([self.low, len(self.occupied), len(self.remainders)], "<i8").tobytes()
        width = (self.low + 7) // 8  # whole bytes a remainder
        rest = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        small = np.minimum(self.counts, 255).astype(np.uint8)
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.runends).tobytes() + rest + small.tobytes() + self.counts[self.counts >= 255].astype("<i8").tobytes()

    @classmethod
    def unpack(cls, data: bytes):
        low, q, n = (int(x) for x in np.frombuffer(data, "<i8", 3))
        at, width = 24, (low + 7) // 8
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, (q + 7) // 8, at), count=q).astype(bool)
        at += (q + 7) // 8
        runends = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        at += (n + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, "<i8", -1, at + n) if (counts == 255).any() else 0
        return cls(low, occupied, runends, wide.view("<u8").ravel(), counts)


def _add(place: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, place, counts)
    return out


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, common.BLANKS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    plain = [normalise(t) for t in texts]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": batch.column("doc_id"),
            "row": batch.column("row"),
            "print": pa.array([_signed(xxhash.xxh3_64_intdigest(p)) for p in plain], pa.int64()),
            "sha": pa.array([hashlib.sha256(p).digest() for p in plain], pa.binary()),
            "points": pa.array([len(t or "") for t in texts], pa.int64()),
        }
    )


def range_bits(rows: int) -> int:
    """Upper bits of a fingerprint that name its range: 64 ranges, or as many as hold `PRINTS` rows each."""
    return min(32, max(6, (rows // PRINTS).bit_length()))


def _build(bits: int):
    """A task's filters: one for each range of fingerprints that has any."""

    def run(batches):
        parts = [batch.column("print").to_numpy().view(np.uint64) for batch in batches]
        prints = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        ranges = (prints >> np.uint64(64 - bits)).astype(np.int64)
        found = np.unique(ranges)
        cuts = np.searchsorted(ranges, found), np.searchsorted(ranges, found, side="right")
        at = np.stack(cuts, 1).tolist()
        for few in range(0, len(found), 1024):
            filters = [QuotientFilter.build(prints[a:b], skip=bits).pack() for a, b in at[few : few + 1024]]
            yield pa.RecordBatch.from_pydict({"range": pa.array(found[few : few + 1024], pa.int64()), "filter": pa.array(filters, pa.binary())})

    return run


def _merge(bits: int):
    """Filters of a range into one; fingerprints with a count above one."""

    def run(table: pa.Table) -> pa.Table:
        prefix = table.column("range")[0].as_py()
        filters = [QuotientFilter.unpack(x.as_py()) for x in table.column("filter")]
        merged = QuotientFilter.build(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]), bits)
        more = merged.counts > 1
        return pa.table({"print": pa.array(merged.fingerprints(prefix, bits)[more].view(np.int64), pa.int64()), "n": pa.array(merged.counts[more], pa.int64())})

    return run


class Route:
    """The normalised texts whose fingerprint is among the broadcast ones."""

    def __init__(self, wanted):
        self.wanted = wanted

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        plain = [normalise(t) for t in batch.column("text").to_pylist()]
        prints = np.array([xxhash.xxh3_64_intdigest(p) for p in plain], np.uint64).view(np.int64)
        wanted = self.wanted.value
        place = np.searchsorted(wanted, prints)
        hit = (place < len(wanted)) & (wanted[np.minimum(place, len(wanted) - 1)] == prints) if len(wanted) else np.zeros(len(prints), bool)
        rows = np.flatnonzero(hit)
        return pa.RecordBatch.from_pydict({"print": pa.array(prints[rows], pa.int64()), "plain": pa.array([plain[i] for i in rows], pa.binary())})


class Normalise:
    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        plain = [normalise(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"print": pa.array([_signed(xxhash.xxh3_64_intdigest(p)) for p in plain], pa.int64()), "plain": pa.array(plain, pa.binary())})


def _groups(rows: DataFrame, slim: DataFrame, total: int, broadcast_fingerprints: int) -> DataFrame:
    """sha, group_size, keep_id and keep_row of the groups of two rows or more, compared by their bytes."""
    spark, bits = rows.sparkSession, range_bits(total)
    prints = slim.select("print").coalesce(max(2 * spark.sparkContext.defaultParallelism, total // (4 * PRINTS)))
    filters = prints.mapInArrow(common.tidy(_build(bits)), "range long, filter binary")
    twice = common.settle(filters.groupBy("range").applyInArrow(_merge(bits), "print long, n long"), "twice", total)
    n_twice = twice.count()
    schema = "print long, plain binary"
    if n_twice <= broadcast_fingerprints:
        wanted = np.sort(twice.select("print").toArrow().column("print").to_numpy())
        routed = common.map_chunks(rows, Route(spark.sparkContext.broadcast(wanted)), schema)
    else:
        routed = common.map_chunks(rows, Normalise(), schema).join(twice.select("print"), "print", "left_semi")
    # Grouping by the bytes themselves is the verification; equal rows meet in partial sums first.
    groups = routed.groupBy("print", "plain").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = groups.select(F.unhex(F.sha2("plain", 256)).alias("sha"), "group_size")
    # Which row stays is told by the numbers that were stored: those of this second read may be others.
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("d"), F.bitwise_not("row").alias("r"))).alias("best")
    rivals = common.join_with_heavy(slim, twice, ["print"], "n", total).filter("n IS NOT NULL").groupBy("sha").agg(best, F.count(F.lit(1)).alias("there"))
    alike = F.when(F.col("there") == F.col("group_size"), F.col("group_size")).otherwise(F.raise_error(F.lit("the documents differ between two reads of the table")))
    return groups.join(rivals, "sha").select("sha", alike.cast("long").alias("group_size"), F.bitwise_not("best.d").alias("keep_id"), F.bitwise_not("best.r").alias("keep_row"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_fingerprints: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text) for every row.

    Of rows with equal normalised bytes the one with the most code points stays, then the smallest
    doc_id (a null id counts as largest), then the first in the table, so exactly one row of a group is
    kept even where rows repeat. Null counts as empty; texts that are empty when normalised are one
    group. Whole texts count; a long one must fit in a task three times. An empty table gives an empty
    table; other columns are not read. The table is read twice: rows are numbered in the first read and
    found by their digest, so it may be split otherwise in the second; other rows then raise an error.
    """
    spark = docs.sparkSession
    texts = common.id_and_text(docs, id_col, text_col)
    with common.scratch(spark) as keep:
        numbered = texts.withColumn("row", F.monotonically_increasing_id())
        slim = keep(common.map_chunks(numbered, fingerprint, "doc_id long, row long, print long, sha binary, points long"), "prints")
        total = slim.count()
        groups = keep(_groups(texts, slim, total, broadcast_fingerprints), "groups")
    out = common.join_with_heavy(slim.drop("print", "points"), groups, ["sha"], "group_size", total)
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(plain) AS text_sha256
FROM d WINDOW w AS (PARTITION BY plain ORDER BY points DESC, doc_id NULLS LAST)
"""
