"""Byte-level BPE: encode by merge ranks and decode again.

Texts become one array of code points. Each code point gets a symbol (its class, with the look-ahead
the pattern needs), each symbol is a function on the states of a small automaton, and these functions
compose associatively: their closure is a finite monoid, so a blocked scan over monoid elements finds
the state before every code point and with it every boundary, without a regular expression. The
slices between boundaries feed a cache in front of pair merging; the byte offset of every id is kept,
so any range of ids decodes to its bytes. A long text is handled in parts, cut where a boundary is certain.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Symbols: a space or other blank right before a non-blank, any other blank, letter, number, other,
#: apostrophe without suffix, apostrophe with a suffix of one or two letters, document start.
SPACE, BLANK_LAST, BLANK, LETTER, NUMBER, OTHER, QUOTE, QUOTE1, QUOTE2, RESET = range(10)
#: States: nothing read, in letters, in numbers, in others, after a prefixing space, in blanks,
#: one or two letters of a contraction to come, token closed.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, PREFIX, IN_BLANKS, ONE_MORE, TWO_MORE, CLOSED = range(9)
#: The pattern's contractions after the apostrophe.
SUFFIX1 = "stmd"
SUFFIX2 = ("re", "ve", "ll")


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this code point."""
    if symbol == RESET:
        return START, False
    if symbol == LETTER:
        if state == ONE_MORE:
            return CLOSED, False
        if state == TWO_MORE:
            return ONE_MORE, False
        return IN_LETTERS, state not in (IN_LETTERS, PREFIX)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PREFIX)
    if symbol in (OTHER, QUOTE, QUOTE1, QUOTE2):
        if state in (IN_OTHERS, PREFIX) or symbol in (OTHER, QUOTE):
            return IN_OTHERS, state not in (IN_OTHERS, PREFIX)
        return (ONE_MORE if symbol == QUOTE1 else TWO_MORE), True
    if symbol == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (PREFIX if symbol == SPACE else CLOSED), True


@functools.cache
def automaton():
    """(element of each symbol, composition table, image of each element on START.., starts[state, symbol])."""
    identity = tuple(range(9))
    base = [tuple(_step(x, s)[0] for s in range(9)) for x in range(10)]
    elements = {identity: 0}
    queue = [identity]
    while queue:
        f = queue.pop()
        for g in base:
            h = tuple(g[s] for s in f)
            if h not in elements:
                elements[h] = len(elements)
                queue.append(h)
    order = sorted(elements, key=elements.get)
    n = len(order)
    table = np.array([[elements[tuple(g[s] for s in f)] for g in order] for f in order], np.uint16)
    assert n <= 65535
    starts = np.array([[_step(x, s)[1] for x in range(10)] for s in range(9)])
    return np.array([elements[g] for g in base], np.uint16), table, np.array(order, np.uint8), starts


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, BLANK or OTHER of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = BLANK
    return out


def scan(symbols: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """State before each symbol, by a blocked associative scan over the transition monoid."""
    of, table, image, _ = automaton()
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.uint8)
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, RESET, np.uint8)
    padded[:n] = symbols
    grid = of[padded.reshape(lanes, steps).T]  # a column of time steps for each lane
    flat, width = table.ravel(), np.int64(table.shape[0])
    inner = np.empty((steps, lanes), np.uint16)
    inner[0] = 0
    running = grid[0].astype(np.int64)
    for k in range(1, steps):
        inner[k] = running
        running = flat[running * width + grid[k]].astype(np.int64)
    before = np.zeros(lanes, np.int64)  # exclusive scan of the lanes' totals, by doubling
    total = np.concatenate([[0], running[:-1]])
    gap = 1
    while gap < lanes:
        total = np.concatenate([total[:gap], flat[total[:-gap] * width + total[gap:]]]).astype(np.int64)
        gap *= 2
    before[:] = total
    entry = image[before, START]
    states = image.ravel()[inner.astype(np.int64) * 9 + entry[None, :]]
    return states.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where a piece starts. `first`: positions of document starts, each preceded by a separator."""
    kinds = classes()[points]
    n = len(points)
    separator = np.zeros(n + 1, bool)
    separator[first - 1] = True
    separator[n] = True
    symbols = kinds.copy()
    blank = kinds == BLANK
    after = np.empty(n, bool)  # a non-blank follows in the same document
    after[:-1] = ~blank[1:]
    after[-1] = False
    after &= ~separator[1:]
    last = blank & after
    symbols[last] = np.where(points[last] == 0x20, SPACE, BLANK_LAST)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        gone = np.concatenate([separator, [True, True]])
        one, two = padded[quotes + 1].copy(), padded[quotes + 2].copy()
        one[gone[quotes + 1]] = 0
        two[gone[quotes + 1] | gone[quotes + 2]] = 0
        kind = np.full(len(quotes), QUOTE, np.uint8)
        kind[np.isin(one, [ord(c) for c in SUFFIX1])] = QUOTE1
        for a, b in SUFFIX2:
            kind[(one == ord(a)) & (two == ord(b))] = QUOTE2
        symbols[quotes] = kind
    symbols[separator[:n]] = RESET
    starts = automaton()[3]
    return np.flatnonzero(starts.ravel()[scan(symbols).astype(np.int64) * 10 + symbols])


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of the texts in order, and the number of pieces of each."""
    if not texts:
        return [], np.zeros(0, np.int64)
    joined = "\x00" + "\x00".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = 1 + np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = boundaries(points, first)
    ends = np.concatenate([starts[1:], [len(points)]]) if len(starts) else starts
    owner = np.searchsorted(first, starts, side="right") - 1
    ends = np.minimum(ends, first[owner] + lengths[owner]) if len(starts) else ends
    cut = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return cut, np.bincount(owner, minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)


#: Characters of a text that are handled at a time: the arrays of a scan are some thirty times as large.
LONG = 1 << 20
#: Between a letter or digit and a blank there always is a boundary, whatever stands before or after.
_CERTAIN = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n])").search


def parts_of(text: str, limit: int | None = None):
    """Parts of about `limit` characters whose pieces are those of the whole text."""
    at, limit = 0, limit or LONG
    while at < len(text):
        m = _CERTAIN(text, at + limit) if at + limit < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    """Encoder and decoder over a file of ranks, with a bounded cache of pieces."""

    def __init__(self, path: str, cache_size: int = 200_000):
        self.ranks = load_ranks(path)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.size_of = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.cache = common.Memo(lambda piece: np.array(self.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes(), cache_size)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: always merge the adjacent pair of least rank, leftmost first."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        far = len(self.bytes_of)
        pairs = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < far:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], far)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same in n log n, for pieces without end."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [ranks[p] for p in parts if p is not None]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit arrays."""
        cut, counts = pieces(texts)
        self.cache = self.cache.tidied()
        packed = list(map(self.cache.__getitem__, cut))
        out, at = [], 0
        for n in counts.tolist():
            out.append(np.frombuffer(b"".join(packed[at : at + n]), "<u4"))
            at += n
        return out

    def encode_in_parts(self, texts: list[str]):
        """For each text its ids in one array, or in several if it is long, made as they are asked for."""
        short = self.encode([t if len(t) <= LONG else "" for t in texts])
        for text, ids in zip(texts, short, strict=True):
            yield iter([ids]) if len(text) <= LONG else (self.encode([part])[0] for part in parts_of(text))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each id starts, and the length of all as a last entry."""
        return np.concatenate([[0], np.cumsum(self.size_of[ids])])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_at(self, ids: np.ndarray, offsets: np.ndarray, start: int = 0, stop: int | None = None, block: int = 1 << 14) -> bytes:
        """Bytes start to stop of a text: the ids that meet them, each written where its offset says.

        `offsets` has the length of the text as a last entry; `block` ids are handled at a time.
        """
        size = int(offsets[-1])
        start = min(start, size)
        stop = size if stop is None else max(start, min(stop, size))
        first, last = int(np.searchsorted(offsets, start, "right")) - 1, int(np.searchsorted(offsets, stop, "left"))
        low = int(offsets[first])
        out = np.zeros(max(0, int(offsets[last]) - low), np.uint8)
        for at in range(first, last, block):
            to = min(last, at + block)
            begin, end = int(offsets[at]), int(offsets[to])
            source = np.repeat(self.start_of[ids[at:to]] - (offsets[at:to] - begin), np.diff(offsets[at : to + 1])) + np.arange(end - begin)
            out[begin - low : end - low] = self.flat[source]
        return out[start - low : stop - low].tobytes()


#: The name under which tasks say that they use it (`common.use`).
TOOL = "byte pairs"


@functools.cache
def loaded(path: str) -> Coder:
    """One coder for each Python worker: its cache serves all tasks until one uses another tool."""
    return Coder(path)


common.cached_tool(TOOL, loaded.cache_clear)


class Encode:
    """Batch function of `encode`: ids and the byte offset of each, packed little-endian."""

    def __init__(self, path: str):
        self.path = path

    def start(self) -> Coder:
        return loaded(self.path)

    def __call__(self, batch: pa.RecordBatch, coder: Coder) -> pa.RecordBatch:
        ids = [np.concatenate(list(parts)) for parts in coder.encode_in_parts([t or "" for t in batch.column("text").to_pylist()])]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
                "offsets": pa.array([coder.offsets(x)[:-1].astype("<i8").tobytes() for x in ids], pa.binary()),
            }
        )


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (u32 little-endian) and offsets (i64 little-endian: byte where each id starts).

    A null or empty text has no ids. Rows are neither merged nor reordered; ids may be null or repeat. A long
    text is encoded in parts, but for a stretch without a blank after a letter or digit, which must fit in
    a task some thirty times. An empty table gives an empty table; other columns are not read.
    """
    return common.map_chunks(common.id_and_text(docs, id_col, text_col), Encode(path), "doc_id long, n_tokens long, ids binary, offsets binary", tool=TOOL)


class Decode:
    """Batch function of `decode`: the bytes from `start` to `stop` of each text, by the offsets of its ids."""

    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.begin, self.end = path, start, stop

    def __call__(self, batch: pa.RecordBatch, coder: Coder) -> pa.RecordBatch:
        out = []
        for packed, held in zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist(), strict=True):
            ids, offsets = np.frombuffer(packed or b"", "<u4"), np.frombuffer(held or b"", "<i8")
            if len(offsets) != len(ids):
                raise ValueError("ids without their offsets")
            size = int(offsets[-1] + coder.size_of[ids[-1]]) if len(ids) else 0
            out.append(coder.decode_at(ids, np.append(offsets, size), self.begin, self.end))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bytes": pa.array(out, pa.binary())})


def decode(encoded: DataFrame, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id and the bytes from `start` to `stop` (the end, if none) of what `encode` has encoded.

    Only the ids that meet that range, found by their offsets, are looked up. Null ids decode to no bytes;
    a range beyond a text's end has none.
    """
    work = Decode(path, start, stop)

    def run(batches):
        coder = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield work(batch.slice(at, 256), coder)

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(common.tidy(run, TOOL), "doc_id long, bytes binary")


class RoundTrip:
    """Encode, then decode from the ids and their byte offsets, in one pass over the rows."""

    def __init__(self, path: str):
        self.path = path

    def start(self) -> Coder:
        return loaded(self.path)

    def __call__(self, batch: pa.RecordBatch, coder: Coder) -> pa.RecordBatch:
        counts, named, decoded = [], [], []
        for parts in coder.encode_in_parts([t or "" for t in batch.column("text").to_pylist()]):
            n, names, body = 0, hashlib.sha256(), hashlib.sha256()
            for ids in parts:
                names.update(("," * bool(n) + ",".join(map(coder.decimal.__getitem__, ids.tolist()))).encode())
                body.update(coder.decode_at(ids, coder.offsets(ids)))
                n += len(ids)
            counts.append(n)
            named.append(names.hexdigest())
            decoded.append(body.hexdigest())
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(named, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to; same cases as `encode`."""
    return common.map_chunks(common.id_and_text(docs, id_col, text_col), RoundTrip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", tool=TOOL)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
