"""Packing of token sequences by minimum bin slack.

A window of `capacity` ids is filled from a pool of remaining pieces: the longest piece opens it, and a
subset-sum over the multiset of remaining lengths, kept as bitsets (one bit a reachable sum, lengths'
counts in binary parts), finds the sum closest to the room that is left; the choice is traced back to
counts of each length. Full windows are cut off long documents first. What the pool ends with is cut
at powers of two, where a sequence needs no padding. All of it happens in the task that read the rows:
packing shuffles nothing, and a pool is bounded in pieces whatever the table's size.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common
from .word_tokens import TOOL, loaded

#: Lengths that one window's subset-sum looks at: more only help when those can't fill the window.
BREADTH = 64


def best_fill(lengths: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths whose sum comes closest to `room` from below; exact for the multiset given."""
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for size in sorted(lengths, reverse=True):
        left = min(lengths[size], room // size) if size else 0
        part = 1
        while left > 0:  # counts in binary parts: 1, 2, 4, ..., rest
            take = min(part, left)
            grown = reach | (reach << (take * size)) & mask
            trail.append((size, take, reach))
            reach = grown
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for size, take, before in reversed(trail):
        if not before >> total & 1:
            chosen[size] += take
            total -= take * size
    return dict(chosen)


class Pool:
    """Remaining pieces by length; hands out windows."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_length: dict[int, list] = defaultdict(list)
        self.pieces = self.total = 0

    def add(self, piece: tuple, length: int) -> None:
        self.by_length[length].append(piece)
        self.pieces += 1
        self.total += length

    def take(self, length: int) -> tuple:
        held = self.by_length[length]
        piece = held.pop()
        if not held:
            del self.by_length[length]
        self.pieces -= 1
        self.total -= length
        return piece

    def window(self) -> list[tuple]:
        """The longest piece and the best fill of the rest, at first among BREADTH lengths spread evenly."""
        longest = max(self.by_length)
        out = [(self.take(longest), longest)]
        room = self.capacity - longest
        fits = sorted(n for n in self.by_length if n <= room)
        few = fits if len(fits) <= BREADTH else [fits[i * (len(fits) - 1) // (BREADTH - 1)] for i in range(BREADTH)]
        chosen = best_fill({n: len(self.by_length[n]) for n in few}, room) if room and few else {}
        if len(few) < len(fits) and sum(n * k for n, k in chosen.items()) < room:
            chosen = best_fill({n: len(self.by_length[n]) for n in fits}, room)
        for n, k in chosen.items():
            out += [(self.take(n), n) for _ in range(k)]
        return out


class Packer:
    """Packs documents as they come; `add` and `finish` yield whole sequences.

    A sequence is a list of (document, start, ids) in order. Slack that no piece fills is filled by
    cutting the longest piece that remains.
    """

    def __init__(self, capacity: int = 4096, pool: int = 4096):
        self.capacity, self.limit, self.pool = capacity, pool, Pool(capacity)

    def add(self, document, ids: np.ndarray):
        whole = len(ids) - len(ids) % self.capacity
        for at in range(0, whole, self.capacity):
            yield [(document, at, ids[at : at + self.capacity])]
        if len(ids) > whole:
            self.pool.add((document, whole, ids[whole:].copy()), len(ids) - whole)  # a slice would keep the whole document
        while self.pool.pieces > self.limit and self.pool.total >= self.capacity:
            yield self._next()

    def _next(self):
        window = [piece for piece, _ in self.pool.window()]
        room = self.capacity - sum(len(p[2]) for p in window)
        while room and self.pool.pieces:
            longest = max(self.pool.by_length)
            document, start, ids = self.pool.take(longest)
            window.append((document, start, ids[:room]))
            if len(ids) > room:
                self.pool.add((document, start + room, ids[room:]), len(ids) - room)
            room = self.capacity - sum(len(p[2]) for p in window)
        return window

    def finish(self):
        while self.pool.total >= self.capacity:
            yield self._next()
        rest = []
        while self.pool.pieces:
            rest.append(self.pool.take(max(self.pool.by_length)))
        total = sum(len(p[2]) for p in rest)
        while total:
            size = 1 << (total.bit_length() - 1)
            window, room = [], size
            while room:
                document, start, ids = rest.pop(0)
                window.append((document, start, ids[:room]))
                if len(ids) > room:
                    rest.insert(0, (document, start + room, ids[room:]))
                room -= len(window[-1][2])
            yield window
            total -= size


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, pool: int = 4096, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids (`keep_ids`) or their crc32.

    Null and empty texts are their end id alone; null and repeated doc_ids are packed row by row; a long
    text is encoded in parts and fills windows of its own, four bytes an id being held; an empty table
    gives no row; other columns are not read. `sequence_id` is the task's number times 2**40 plus a count, so it is
    the same when a lost task runs again.
    """

    def run(batches):
        tokens, packer = loaded(tokenizer), Packer(capacity, pool)
        end = np.uint32(end_id)
        first, n, out = TaskContext.get().partitionId() << 40, 0, []

        def rows(sequences):
            nonlocal n
            for sequence in sequences:
                offset = 0
                for (doc_id, size), start, ids in sequence:
                    out.append((doc_id, start, len(ids), common.crc32_ids(ids), size, first + n, offset, *([ids.tobytes()] if keep_ids else [])))
                    offset += len(ids)
                n += 1

        for batch in batches:
            for part in common.chunks(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokens.encode_batch(part.column("text").to_pylist()), strict=True):
                    ids = np.append(ids, end)
                    rows(packer.add((doc_id, len(ids)), ids))
                    if len(out) >= 10_000:
                        yield _rows(out, keep_ids)
                        out.clear()
        rows(packer.finish())
        if out:
            yield _rows(out, keep_ids)

    return common.id_and_text(docs, id_col, text_col).mapInArrow(common.tidy(run, TOOL), SCHEMA + (", ids binary" if keep_ids else ""))


def _rows(out: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = list(zip(*out, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[: len(names)]] + ([pa.array(columns[-1], pa.binary())] if keep_ids else [])
    return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * keep_ids)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
