"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums.

Layout of a file (integers little-endian), its documents in ascending order of doc_id, null ids first:

    magic "TSRTOK02"
    frame...     zstandard frames, each with its content checksum, of whole documents: u64 documents n,
                 n x i64 doc_id, n x u8 present (0: null id), n x u64 n_tokens, then the u32 ids
    seek table   per frame: u64 offset, u64 compressed size, u64 raw size, u64 documents, u64 ids,
                 i64 first doc_id, u8 present, u32 crc32 of the compressed frame
    footer       u64 frames, u64 documents, u64 ids, u32 crc32 of the seek table and these three, magic

A document longer than a frame has a frame to itself. A reader takes the footer and the seek table, then
only the frames that can hold the documents asked for, and verifies each frame's checksum.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .word_tokens import TOOL, loaded

MAGIC = b"TSRTOK02"
_FRAME = struct.Struct("<QQQQQqBI")
_FOOTER = struct.Struct("<24sI8s")
_TOTALS = struct.Struct("<QQQ")
#: Raw bytes and documents of a frame, at which it is closed.
FRAME_BYTES, FRAME_DOCUMENTS = 1 << 20, 1 << 14
#: Bytes of input (as the plan estimates them) of a shard; small inputs are split further, for the cores.
SHARD_BYTES, LEAST_BYTES = 64 << 20, 1 << 19


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Writer:
    """Appends documents, in order, to a stream; `close` adds the seek table. Holds one frame and the table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.pending: list[tuple[int | None, bytes]] = []
        self.size = self.documents = self.ids = 0
        self.last: tuple[bool, int] | None = None
        self.at = stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        place = (doc_id is not None, doc_id or 0)
        if self.last is not None and place < self.last:
            raise ValueError(f"document {doc_id} after {self.last[1]}")
        self.last = place
        if self.pending and (self.size + len(ids) > self.frame_bytes or len(self.pending) >= FRAME_DOCUMENTS):
            self._flush()
        self.pending.append((doc_id, ids))
        self.size += len(ids)

    def _flush(self) -> None:
        if not self.pending:
            return
        names, bodies = [d for d, _ in self.pending], [x for _, x in self.pending]
        head = np.array([len(names)], "<u8").tobytes() + np.array([d or 0 for d in names], "<i8").tobytes() + np.array([d is not None for d in names], np.uint8).tobytes()
        raw = b"".join([head, np.array([len(x) // 4 for x in bodies], "<u8").tobytes(), *bodies])
        frame = self.pack.compress(raw)
        self.frames.append(_FRAME.pack(self.at, len(frame), len(raw), len(names), self.size // 4, names[0] or 0, names[0] is not None, zlib.crc32(frame)))
        self.at += self.stream.write(frame)
        self.documents, self.ids = self.documents + len(names), self.ids + self.size // 4
        self.pending, self.size = [], 0

    def close(self) -> None:
        self._flush()
        seek = b"".join(self.frames)
        totals = _TOTALS.pack(len(self.frames), self.documents, self.ids)
        self.stream.write(seek + _FOOTER.pack(totals, zlib.crc32(seek + totals), MAGIC))


class Reader:
    """Random access to one file; holds its seek table."""

    def __init__(self, path: str):
        fs, place = _filesystem(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        totals, crc, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size)) if size >= _FOOTER.size else (b"", 0, b"")
        if magic != MAGIC:
            raise ValueError(f"{path}: no token file")
        n, self.documents, self.ids = _TOTALS.unpack(totals)
        first = size - _FOOTER.size - n * _FRAME.size
        seek = self._read(first, n * _FRAME.size) if first >= len(MAGIC) else b""
        if first < len(MAGIC) or zlib.crc32(seek + totals) != crc:
            raise ValueError(f"{path}: damaged seek table")
        self.frames = list(_FRAME.iter_unpack(seek))

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def frame(self, k: int):
        """(doc_id, ids) of a frame's documents."""
        at, packed, raw, n, _, _, _, crc = self.frames[k]
        data = self._read(at, packed)
        if zlib.crc32(data) != crc:
            raise ValueError(f"frame {k}: checksum differs")
        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=raw)
        names, present = np.frombuffer(data, "<i8", n, 8).tolist(), np.frombuffer(data, np.uint8, n, 8 + 8 * n).tolist()
        ends = np.cumsum(np.frombuffer(data, "<u8", n, 8 + 9 * n).astype(np.int64))
        ids = np.frombuffer(data, "<u4", -1, 8 + 17 * n)
        for name, there, part in zip(names, present, np.split(ids, ends[:-1]), strict=True):
            yield (name if there else None), part

    def scan(self):
        """(doc_id, ids before it in this file, ids) of every document, a frame at a time."""
        before = 0
        for k in range(len(self.frames)):
            for doc_id, ids in self.frame(k):
                yield doc_id, before, ids
                before += len(ids)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of the documents of this id; only frames that can hold them are decompressed."""
        firsts, wish = [(bool(f[6]), f[5]) for f in self.frames], (doc_id is not None, doc_id or 0)
        first, last = max(0, bisect.bisect_left(firsts, wish) - 1), bisect.bisect_right(firsts, wish)
        return [ids for k in range(first, last) for name, ids in self.frame(k) if name == doc_id]


def _shards(rows: DataFrame) -> int:
    """Shards of about SHARD_BYTES, by the plan's estimate of its size or, where it has none, by a count of bytes."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = rows.agg(F.coalesce(F.sum(8 + F.coalesce(F.octet_length("text"), F.lit(0))), F.lit(0))).first()[0]
    return max(1, -(-size // SHARD_BYTES), min(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shards: int | None = None, frame_bytes: int = FRAME_BYTES, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode whole texts, append `end_id`, and write shards whose order is that of doc_id.

    Returns (path, documents, ids) of each shard that has rows, in order: a few numbers a shard. Null
    texts count as empty, null ids come first, rows of one id stand in the order of the table, and an
    empty table gives no shard; a long text has a frame to itself; other columns are not read. A shard is
    written under a name of its attempt and then renamed, so a lost executor leaves no half file. The
    number of shards follows the size of the input unless it is given.
    """
    rows = common.id_and_text(docs, id_col, text_col)
    shards = shards or _shards(rows)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # Texts are dealt out by range before they are encoded: Spark samples the keys in a pass of its own.
    rows = rows.repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row")

    def save(batches):
        writer = stream = None
        tokens = loaded(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        name = f"shard-{TaskContext.get().partitionId():06d}.tok"
        fs, place = _filesystem(path)
        draft = f"{place}/_{uuid.uuid4().hex}"
        for batch in batches:
            for part in common.chunks(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokens.encode_batch(part.column("text").to_pylist()), strict=True):
                    if writer is None:
                        fs.create_dir(place, recursive=True)
                        stream = fs.open_output_stream(draft)
                        writer = Writer(stream, frame_bytes)
                    writer.add(doc_id, ids.astype("<u4").tobytes() + end)
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(draft, f"{place}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "documents": pa.array([writer.documents], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    done = rows.mapInArrow(common.tidy(save, TOOL), "name string, documents long, ids long").collect()  # a row for each shard
    return [(f"{path}/{r['name']}", r["documents"], r["ids"]) for r in sorted(done, key=lambda r: r["name"])]


def read(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of the shards."""
    start, rows = 0, []
    for path, _, ids in shards:
        rows.append((path, start))
        start += ids
    plan = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))

    def scan(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                out: list[tuple] = []
                for doc_id, at, ids in Reader(path).scan():
                    out.append((doc_id, base + at, len(ids), common.crc32_ids(ids)))
                    if len(out) >= 10_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return plan.mapInArrow(common.tidy(scan), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.read_by_results(common.shared_dir(spark, "tokens"))
    return read(spark, write(common.documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json")))
