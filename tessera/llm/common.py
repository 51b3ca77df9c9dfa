"""What the corpus operators share: Arrow mapping, the shared folder, skew-safe joins and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools
import os
import re
import tempfile
import time
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts write it: [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows and bytes of an Arrow batch. Spark's own limits let one batch, with the copies that both sides
#: make of it, take a good part of what an executor has outside its heap.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits on Arrow batches to the above, if they are higher."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int((spark.conf.get(key, None) or "0").rstrip("b") or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the columns an operator reads, so that others can't clash with its own."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *more)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under the one that all executors share (spark.checkpoint.dir).

    Only a session whose tasks all run on this machine may go without that setting: it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"tessera-{what}-{uuid.uuid4().hex}")


#: Folders written by `settle`, innermost scope last; the first list holds what results still read.
_written: list[list[str]] = [[]]


#: Rows of a settled table that one task writes at least, where the number of rows is bounded beforehand.
ROWS_A_TASK = 50_000


def settle(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    `rows` is a bound on its rows, if one is known: a table that a shuffle has left in many small parts
    is then written by no more tasks than that bound asks for (two a core at least).
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    _written[-1].append(path)
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, rows // ROWS_A_TASK))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def remove(df: DataFrame | None) -> None:
    """Deletes a table that `settle` has returned, before its scope ends."""
    if df is not None and (path := getattr(df, "settled_at", None)):
        for scope in _written:
            if path in scope:
                scope.remove(path)
        _delete(df.sparkSession, [path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables settled inside go at the end, but for those settled by the function that it yields."""
    _written.append([])

    def keep(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
        out = settle(df, what, rows)
        _written[-2].append(_written[-1].pop())
        return out

    try:
        yield keep
    finally:
        _delete(spark, _written.pop())


def discard(spark: SparkSession) -> None:
    """Deletes the tables and files that results of this session read; call it when those are no longer needed."""
    _delete(spark, _written[0])
    _written[0].clear()


def read_by_results(path: str) -> str:
    """A folder that `discard` deletes, though `settle` hasn't written it."""
    _written[0].append(path)
    return path


def free_name(columns: list[str], wish: str) -> str:
    """`wish`, or it with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def chunks(batch: pa.RecordBatch, limit: int = 1 << 20):
    """Slices of a batch whose `text` has about `limit` bytes (one row at least)."""
    text = batch.column("text")
    if batch.num_rows == 0:
        return
    offsets = np.int64 if pa.types.is_large_string(text.type) else np.int32
    ends = np.frombuffer(text.buffers()[1], offsets)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        stop = min(batch.num_rows, max(stop, at + 1))
        yield batch.slice(at, stop - at)
        at = stop


_trimmed = 0.0


def trim(force: bool = False) -> None:
    """Gives memory that this Python worker has freed back to the system, once a second at most.

    Workers live on between tasks and stages; what their allocators hold back adds up on an executor.
    """
    global _trimmed
    now = time.monotonic()
    if not force and now - _trimmed < 1:
        return
    _trimmed = now
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: What empties the caches that a tool keeps in a Python worker, by its name, and the tool used last.
_tools: dict[str, Callable[[], None]] = {}
_tool = ""


def cached_tool(name: str, clear: Callable[[], None]) -> None:
    _tools[name] = clear


def use(tool: str = "") -> None:
    """Says which cached tool a task works with; those of another one go, since workers outlive stages."""
    global _tool
    if tool != _tool:
        if _tool in _tools:
            _tools[_tool]()
            trim(force=True)
        _tool = tool


def tidy(run, tool: str = ""):
    """A batch function for mapInArrow that trims its worker as it goes and at its end."""

    def tidied(batches):
        use(tool)
        try:
            for out in run(batches):
                yield out
                trim()
        finally:
            trim(force=True)

    return tidied


def map_chunks(df: DataFrame, function, schema: str, limit: int = 1 << 20, tool: str = "") -> DataFrame:
    """mapInArrow over slices of bounded text; `function` takes and returns a RecordBatch.

    `function` may have a `start()` that makes per-task state, passed as its second argument. `tool` names
    the cached tool that it uses.
    """

    def run(batches):
        state = function.start() if hasattr(function, "start") else None
        for batch in batches:
            for part in chunks(batch, limit):
                yield function(part, state) if state is not None else function(part)

    return df.mapInArrow(tidy(run, tool), schema)


def join_with_heavy(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, share: int = 1024) -> DataFrame:
    """Left join on keys of which some may hold a large part of all rows of `left`.

    `right` has one row a key, with the number of rows of `left` it meets in `weight`. Keys with more
    than total/share rows number under `share`, which bounds what is broadcast; the rest is shuffled.
    """
    floor = max(1, total // share)
    heavy = right.filter(F.col(weight) > floor)
    light = right.filter(F.col(weight) <= floor)
    mark = heavy.select(*keys, F.lit(True).alias("_heavy"), *[c for c in right.columns if c not in keys])
    seen = left.join(F.broadcast(mark), keys, "left")
    done = seen.filter(F.col("_heavy").isNotNull()).drop("_heavy")
    rest = seen.filter(F.col("_heavy").isNull()).select(*left.columns).join(light, keys, "left")
    return done.unionByName(rest.select(*done.columns))


#: Tables of up to so many rows of one number are broadcast; larger ones are shuffled.
BROADCAST_NUMBERS = 1 << 20


def small_or_shuffled(numbers: DataFrame, limit: int | None = None) -> DataFrame:
    """A settled table of one number a row, marked for broadcast if it is counted as small."""
    return F.broadcast(numbers) if numbers.count() <= (BROADCAST_NUMBERS if limit is None else limit) else numbers


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


# Words of byte arrays.

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x100000001B3
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.cache
def _bytes_mixed() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def nonblank(data: np.ndarray) -> np.ndarray:
    """The bytes of all words, one after another."""
    return data[~_BLANK[data]]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than ASCII white space."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[data], [True]])))
    return edges[::2], edges[1::2]


def span_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span to look it up by: a polynomial in its mixed bytes, from prefix sums, and its length.

    Different spans can have the same number (texts can be made to), so whoever finds something by it
    must compare the bytes.
    """
    size = 1 << max(10, len(data).bit_length())
    up, down = _powers(size, _STEP), _powers(size, pow(_STEP, -1, 1 << 64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_bytes_mixed()[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


def word_hashes(found: list[bytes]) -> np.ndarray:
    """128-bit hashes (two u64 a row) of words; each different word is hashed once."""
    n = len(found)
    first: dict[bytes, int] = {}
    codes = np.fromiter(map(first.setdefault, found, itertools.count()), np.int64, n)
    row = np.zeros(n, np.int64)
    row[np.fromiter(first.values(), np.int64, len(first))] = np.arange(len(first))
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, first)), "<u8").reshape(-1, 2)[row[codes]]


_SOME_BLANK = re.compile(rb"[\x20\x09-\x0D]").search


def cut_at_blanks(body: bytes, limit: int):
    """Parts of about `limit` bytes that end before a blank: no word is cut, so one may make its part longer."""
    at = 0
    while at < len(body):
        end = min(len(body), at + limit)
        if end < len(body):
            end = m.start() if (m := _SOME_BLANK(body, end)) else len(body)
        yield body[at:end]
        at = end


def runs(data: list[bytes], limit: int):
    """(document, bytes) in runs of about `limit` bytes; a longer document is cut at blanks.

    A part longer than `limit`, which has a word of that kind, is a run of its own.
    """
    run, size = [], 0
    for d, body in enumerate(data):
        for part in cut_at_blanks(body, limit):
            if run and len(part) > 2 * limit:
                yield run
                run, size = [], 0
            run.append((d, part))
            size += len(part)
            if size >= limit:
                yield run
                run, size = [], 0
    if run:
        yield run


class Memo(dict):
    """A function's values by text, in two generations: when the young one is full it becomes the old one.

    Looking up costs no Python frame for a text that the young generation knows. Long texts aren't kept.
    """

    def __init__(self, make, limit: int, old: dict | None = None):
        super().__init__()
        self.make, self.limit, self.old = make, limit, old or {}

    def __missing__(self, text: str):
        value = self.old.get(text)
        if value is None:
            value = self.make(text)
        if len(text) <= 64:
            self[text] = value
        return value

    def tidied(self) -> Memo:
        if len(self) < self.limit:
            return self
        self.old = None
        return Memo(self.make, self.limit, self)
