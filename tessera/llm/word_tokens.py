"""The lower-case word tokenizer of a `tokenizers` file, with a cache in front of the library's model.

No token of such a file spans white space, so a text is cut at ASCII white space and each chunk is encoded
once. Chunks within Latin-1 are normalised here (NFC leaves them as they are, lower case is one to
one) and handed piece by piece to the library's model; all others go through the whole library.
"""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np
import regex
from tokenizers import Tokenizer

from . import common
from .common import Memo

#: Some libraries count these as white space and others don't: texts with one go to the library whole.
_ODD_BLANKS = "\x1c\x1d\x1e\x1f"
_PLAIN = re.compile("[\x00-\xff]*").fullmatch
_packed = struct.Struct("<I").pack
#: Stands between the ids of chunks that are encoded together; no id is as large.
_MARK = b"\xff\xff\xff\xff"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter of each byte: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Ids of texts. What a chunk encodes to is kept in arrays with the chunk's bytes, found by a 64-bit number.

    A batch of texts is looked up, compared byte by byte and put together in numpy; only chunks that
    aren't known yet take Python steps. A chunk whose number is that of another one is found out by its
    bytes and encoded by itself. The arrays are emptied when they hold `capacity` chunks.
    """

    def __init__(self, path: str, capacity: int = 500_000):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        spec = json.loads(self.library.to_str())
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]:
            raise ValueError("not a lower-case word tokenizer")
        self.cut = regex.compile(split["pattern"]["Regex"] + r"|\n").findall
        self.model = self.library.model
        self.letters = _byte_letters()
        self.packed = [_packed(i) for i in range(self.library.get_vocab_size())]
        self._numbers = common.span_places
        self.capacity = capacity
        self.parts = Memo(self._part, 80_000)
        self._clear()

    def _clear(self) -> None:
        slots = 1 << (4 * self.capacity // 3).bit_length()
        self.number = np.zeros(slots, np.uint64)
        self.entry = np.full(slots, -1, np.int32)
        self.at, self.size = np.zeros(self.capacity, np.int64), np.zeros(self.capacity, np.int32)
        self.place, self.length = np.zeros(self.capacity, np.int64), np.zeros(self.capacity, np.int32)
        self.ids, self.bytes = np.zeros(1 << 20, np.uint32), np.zeros(1 << 20, np.uint8)
        self.known = self.used = self.filled = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if part == "\n":
            return _MARK
        word = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(word)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, packed; it holds no line break."""
        if not _PLAIN(chunk):
            return self._whole(chunk)
        return b"".join(map(self.parts.__getitem__, self.cut(chunk.lower())))

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and how many each has; those within Latin-1 are cut together."""
        text, others = b"\n".join(chunks).decode("utf-8", "surrogatepass"), {}
        if not _PLAIN(text):
            each = text.split("\n")
            others = {k: self._whole(c) for k, c in enumerate(each) if not _PLAIN(c)}
            text = "\n".join("" if k in others else c for k, c in enumerate(each))
        ids = np.frombuffer(b"".join(map(self.parts.__getitem__, self.cut(text.lower() + "\n"))), "<u4")
        ends = np.flatnonzero(ids == 0xFFFFFFFF)
        sizes = np.diff(ends, prepend=-1) - 1
        if others:
            parts = [p[:-1] for p in np.split(ids, ends[:-1] + 1)]
            for k, packed in others.items():
                parts[k] = np.frombuffer(packed, "<u4")
                sizes[k] = len(parts[k])
            return np.concatenate(parts), sizes
        return ids[ids != 0xFFFFFFFF], sizes

    def _find(self, numbers: np.ndarray) -> np.ndarray:
        """Entry of each number, -1 if there is none: probing slot after slot."""
        out = np.full(len(numbers), -1, np.int32)
        mask = np.uint64(len(self.entry) - 1)
        left, slot = np.arange(len(numbers)), (numbers & mask).astype(np.int64)
        while len(left):
            found = self.entry[slot]
            same = (self.number[slot] == numbers[left]) & (found >= 0)
            out[left[same]] = found[same]
            on = (found >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & int(mask)
        return out

    def _insert(self, numbers: np.ndarray, entries: np.ndarray) -> None:
        """Puts distinct new numbers into free slots; of those that want one slot the first gets it."""
        mask = np.uint64(len(self.entry) - 1)
        left, slot = np.arange(len(numbers)), (numbers & mask).astype(np.int64)
        while len(left):
            free = self.entry[slot] < 0
            place, who = np.unique(slot[free], return_index=True)
            got = left[free][who]
            self.number[place], self.entry[place] = numbers[got], entries[got]
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[who]] = False
            left, slot = left[stay], (slot[stay] + 1) & int(mask)

    def _learn(self, numbers: np.ndarray, chunks: list[bytes]) -> np.ndarray:
        """Entries of new chunks."""
        ids, sizes = self._chunks(chunks)
        self.parts = self.parts.tidied()
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        total, letters, entries = len(ids), int(lengths.sum()), np.arange(self.known, self.known + len(chunks), dtype=np.int32)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.uint32)])
        if self.filled + letters > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(letters, len(self.bytes)), np.uint8)])
        if (lack := self.known + len(chunks) - len(self.at)) > 0:  # a run of more chunks than the capacity
            self.at, self.place = (np.concatenate([x, np.zeros(lack, np.int64)]) for x in (self.at, self.place))
            self.size, self.length = (np.concatenate([x, np.zeros(lack, np.int32)]) for x in (self.size, self.length))
        self.ids[self.used : self.used + total] = ids
        self.bytes[self.filled : self.filled + letters] = np.frombuffer(b"".join(chunks), np.uint8)
        self.at[entries], self.size[entries] = self.used + np.cumsum(sizes) - sizes, sizes
        self.place[entries], self.length[entries] = self.filled + np.cumsum(lengths) - lengths, lengths
        self.used, self.known, self.filled = self.used + total, self.known + len(chunks), self.filled + letters
        while 4 * self.known > 3 * len(self.entry):
            self._grow()
        self._insert(numbers, entries)
        return entries

    def _grow(self) -> None:
        held = self.entry >= 0
        numbers, entries = self.number[held], self.entry[held]
        slots = 2 * len(self.entry)
        self.number, self.entry = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self._insert(numbers, entries)

    def _others(self, data: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which chunks of `data` aren't the bytes that their entry holds."""
        odd = self.length[entry] != lengths
        if len(self.bytes) < len(data):  # so that an odd entry, whose comparison means nothing, stays within
            self.bytes = np.concatenate([self.bytes, np.zeros(len(data) - len(self.bytes), np.uint8)])
        ends = np.cumsum(lengths)
        held = self.bytes[np.repeat(np.where(odd, 0, self.place[entry]) - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        odd[np.searchsorted(ends, np.flatnonzero(held != common.nonblank(data)), side="right")] = True
        return np.flatnonzero(odd)

    def _run(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each chunk, start of each chunk) of a byte array."""
        starts, ends = common.words(data)
        numbers = self._numbers(data, starts, ends)
        entry = self._find(numbers)
        new = np.flatnonzero(entry < 0)
        raw = data.tobytes()
        if len(new):
            _, at, place = np.unique(numbers[new], return_index=True, return_inverse=True)
            one = new[at]
            if self.known and (self.known + len(one) > self.capacity or self.used > 8 * self.capacity or self.filled > 32 * self.capacity):
                self._clear()
                return self._run(data)
            entry[new] = self._learn(numbers[one], [raw[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])[place]
        sizes, at, pool = self.size[entry].astype(np.int64), self.at[entry], self.ids
        others = self._others(data, ends - starts, entry)
        if len(others):
            own = [np.frombuffer(self._chunk(raw[i:j].decode("utf-8", "surrogatepass")), "<u4") for i, j in zip(starts[others].tolist(), ends[others].tolist(), strict=True)]
            sizes[others] = list(map(len, own))
            at[others] = self.used + np.cumsum(sizes[others]) - sizes[others]
            pool = np.concatenate([self.ids[: self.used], *own])
        before = np.cumsum(sizes) - sizes
        return pool[np.repeat(at - before, sizes) + np.arange(int(sizes.sum()))], sizes, starts

    def _one_by_one(self, body: bytes) -> np.ndarray:
        """Ids of bytes with a chunk so long that the arrays of a run would be many times as large."""
        return np.frombuffer(b"".join([self._chunk(c.decode("utf-8", "surrogatepass")) for c in body.split()]), "<u4")

    def encode_batch(self, texts: list[str | None], limit: int = 1 << 19) -> list[np.ndarray]:
        """Ids of each whole text as unsigned 32-bit arrays; null has none."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        plain = []
        for d, text in enumerate(texts):
            if text and any(c in text for c in _ODD_BLANKS):
                parts[d].append(np.frombuffer(self._whole(text), "<u4"))
                text = None
            plain.append((text or "").encode("utf-8", "surrogatepass"))
        for run in common.runs(plain, limit):
            if len(run) == 1 and len(run[0][1]) > 4 * limit:
                parts[run[0][0]].append(self._one_by_one(run[0][1]))
                continue
            ids, sizes, starts = self._run(np.frombuffer(b"\n".join(body for _, body in run), np.uint8))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            cuts = ends[np.searchsorted(starts, np.cumsum([len(body) + 1 for _, body in run]))].tolist()
            for (d, _), i, j in zip(run, [0, *cuts[:-1]], cuts, strict=True):
                parts[d].append(ids[i:j])
        return [p[0] if len(p) == 1 else np.concatenate([np.zeros(0, np.uint32), *p]) for p in parts]

    def encode(self, text: str) -> bytes:
        """Ids of one text, packed little-endian."""
        return self.encode_batch([text])[0].astype("<u4").tobytes()


#: The name under which tasks say that they use it (`common.use`).
TOOL = "word tokens"


@functools.cache
def loaded(path: str) -> WordTokens:
    """One tokenizer for each Python worker: its caches serve all tasks until one uses another tool."""
    return WordTokens(path)


common.cached_tool(TOOL, loaded.cache_clear)
