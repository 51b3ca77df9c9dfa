"""Coders run over table rows both ways: what goes in must come out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions.bits import BitReader, BitWriter, ByteReader
from tessera.operators import entropy
from tessera.operators.tagtree import TagTree
from tessera.sources import boxes, codestream, options


def arithmetic(rows: DataFrame) -> DataFrame:
    """k and the hex of its bytes after arithmetic coding and decoding, with contexts taken in turn."""

    def both(data: bytes) -> bytes:
        encoder = entropy.MQEncoder()
        for i, byte in enumerate(data):
            for k in range(8):
                encoder((8 * i + k) % entropy.CONTEXTS, byte >> 7 - k & 1)
        decode, out = entropy.decoder(encoder.flush()), bytearray()
        for i in range(len(data)):
            byte = 0
            for k in range(8):
                byte = byte << 1 | decode((8 * i + k) % entropy.CONTEXTS)
            out.append(byte)
        return bytes(out)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "bytes": pa.array([both(d.as_py()).hex().upper() for d in batch.column("data")], pa.string())})

    return rows.mapInArrow(run, "k long, bytes string")


def code_blocks(lines: DataFrame) -> DataFrame:
    """Lines (y, q) after coding each as a code-block of 16 columns, its orientation by y."""

    def run(batches):
        for batch in batches:
            out = []
            for y, q in zip(batch.column("y").to_pylist(), batch.column("q").to_pylist(), strict=True):
                width = min(16, len(q))
                height = len(q) // width if width else 0
                data, significant, passes = entropy.encode_block(q[: width * height], width, height, y % 4)
                planes = significant + 3
                coded = entropy.decode_block(data, width, height, y % 4, significant, passes, planes)
                out.append([-((v & 0x7FFFFFFF) >> 31 - planes) if v < 0 else v >> 31 - planes for v in coded])
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "q": pa.array(out, pa.list_(pa.int32()))})

    return lines.select("y", "q").mapInArrow(run, "y long, q array<int>")


def tag_trees(leaves: DataFrame) -> DataFrame:
    """(tree, j, i, v) after coding each tree's leaves (row j, column i) to their values and back."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("j", "i", "v")), strict=True))
        width, height = max(r[1] for r in rows) + 1, max(r[0] for r in rows) + 1
        tree, bits = TagTree(width, height), BitWriter()
        for j, i, v in rows:
            tree.set(i, j, v)
        for j, i, v in rows:
            tree.encode(bits, i, j, v + 1)
        back, reader, out = TagTree(width, height), BitReader(ByteReader(bits.done())), []
        for j, i, _ in rows:
            v = 0
            while not back.decode(reader, i, j, v + 1):
                v += 1
            out.append((j, i, v))
        j, i, v = zip(*out, strict=True)
        return pa.table({"tree": pa.array([table.column("tree")[0].as_py()] * len(out), pa.int64()), "j": pa.array(j, pa.int32()), "i": pa.array(i, pa.int32()), "v": pa.array(v, pa.int32())})

    return leaves.groupBy("tree").applyInArrow(run, "tree long, j int, i int, v int")


def segments(files: DataFrame) -> DataFrame:
    """image_id, name and offset of the main header's segments of files."""

    def run(batches):
        for batch in batches:
            rows = [(k.as_py(), name, at) for k, data in zip(batch.column("image_id"), batch.column("content"), strict=True) for name, at, _ in codestream.segments(boxes.codestream(data.as_py()))]
            k, name, at = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"image_id": pa.array(k, pa.int64()), "name": pa.array(name, pa.string()), "place": pa.array(at, pa.int64())})

    return files.select("image_id", "content").mapInArrow(run, "image_id long, name string, place long")


def published(keys: DataFrame) -> DataFrame:
    """k and the hex of the published arithmetic-coder sequence, decoded with one context that starts in state 0."""
    data = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")

    def run(batches):
        for batch in batches:
            out = []
            for _ in range(batch.num_rows):
                decode, word = entropy.decoder(data, [0] * entropy.CONTEXTS), 0
                for _ in range(256):
                    word = word << 1 | decode(0)
                out.append(f"{word:064X}")
            yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "bytes": pa.array(out, pa.string())})

    return keys.select("k").mapInArrow(run, "k int, bytes string")


def published_block(keys: DataFrame) -> DataFrame:
    """k and the samples of a code-block of the standard's worked example: the vertical high band of a column."""

    def run(batches):
        for batch in batches:
            coded = entropy.decode_block(bytes.fromhex("0FB176"), 1, 4, 2, 3, 7, 10)
            samples = [-((v & 0x7FFFFFFF) >> 21) if v < 0 else v >> 21 for v in coded]
            yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "samples": pa.array([samples] * batch.num_rows, pa.list_(pa.int32()))})

    return keys.select("k").mapInArrow(run, "k int, samples array<int>")


def quantisations(keys: DataFrame) -> DataFrame:
    """k, style, guard, exponents and mantissas of the four bands of one level, from QCD segments of each style.

    Style 0 states exponents, 1 only the LL band's values, 2 all values.
    """

    def run(batches):
        for batch in batches:
            out = []
            for k in batch.column("k").to_pylist():
                style, guard = k % 3, k % 8
                values = [(8 + (k + b) % 12, (37 * k + b) % 2048) for b in range(4)]
                if style == 0:
                    body = bytes(e << 3 for e, _ in values)
                else:
                    body = b"".join((e << 11 | m).to_bytes(2, "big") for e, m in values[: 1 if style == 1 else 4])
                h = codestream.Header(levels=1, **codestream._qcd(ByteReader(bytes([guard << 5 | style]) + body)))
                bands = [h.band(b, 1) for b in range(4)]
                out.append((k, h.quant, h.guard, [e for e, _ in bands], [m for _, m in bands]))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "style", "guard", "expn", "mant"])

    return keys.select("k").mapInArrow(run, "k long, style int, guard int, expn array<int>, mant array<int>")


def transforms(keys: DataFrame) -> DataFrame:
    """k, marker, index and what the other Part-2 segments say, made of keys and parsed: ADS, ATK, MCC and MIC."""

    def codes(values: list[int]) -> bytes:
        packed = [0] * codestream.ceil_div(len(values), 4)
        for i, v in enumerate(values):
            packed[i // 4] |= v << 2 * (3 - i % 4)
        return bytes([len(values), *packed])

    def made(k: int):
        index = k % 16
        yield codestream.ADS, bytes([index]) + codes([(k + i) % 4 for i in range(1 + k % 5)]) + codes([i % 4 for i in range(k % 3)]), lambda f: f"{f['decomposition']} {f['sub_levels']}"
        steps = 1 + k % 3
        atk = (index | 1 << 4 | (k % 4) << 7 | 1 << 9 | (k % 2) << 10).to_bytes(2, "big") + bytes([steps, 2, k % 7]) + bytes([0, k]) + bytes(range(2 * steps)) + bytes(2 * steps)
        yield codestream.ATK, atk, lambda f: f"{f['filter']} {f['m0']} {f['offset']} {f['scale']} {len(f['steps'])} {len(f['residues'])}"
        collection = bytes([0, 2, k % 8, k % 8 + 1, 0, 1, k % 8])
        yield codestream.MCC, bytes([index, k % 4]) + collection + bytes([k % 3 << 4 | k % 5]), lambda f: f"{f['collections'][0]['type']} {f['collections'][0]['inputs']} {f['collections'][0]['outputs']}"
        yield codestream.MIC, bytes([index]) + collection + bytes([k % 3 << 4 | k % 5]), lambda f: f"{f['collections'][0]['matrix']} {f['collections'][0]['offset']} {f['collections'][0]['inputs']}"

    def run(batches):
        for batch in batches:
            out = []
            for k in batch.column("k").to_pylist():
                for marker, body, say in made(k):
                    found = codestream.part2(marker, ByteReader(body))
                    out.append((k, found["marker"], found["index"], say(found)))
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.string()]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "marker", "index", "says"])

    return keys.select("k").mapInArrow(run, "k int, marker string, index int, says string")


def run_options(texts: DataFrame) -> DataFrame:
    """k and some options of each INI text."""

    def run(batches):
        for batch in batches:
            found = [options.parse(t) for t in batch.column("text").to_pylist()]
            kinds = {"tile_w": pa.int32(), "tile_h": pa.int32(), "cblk_exp_w": pa.int32(), "wavelet_type": pa.int32(), "bp": pa.float64(), "mct_klt_iterations": pa.int32()}
            yield pa.RecordBatch.from_pydict({"k": batch.column("k")} | {c: pa.array([getattr(o, c) for o in found], t) for c, t in kinds.items()})

    return texts.select("k", "text").mapInArrow(run, "k long, tile_w int, tile_h int, cblk_exp_w int, wavelet_type int, bp double, mct_klt_iterations int")


def part2(keys: DataFrame) -> DataFrame:
    """Transform-matrix segments made of keys k and parsed again."""

    def run(batches):
        for batch in batches:
            out = []
            for k in batch.column("k").to_pylist():
                body = bytes([k % 16 | k % 4 << 4 | 1 << 6]) + bytes(2 * (1 + k % 5))
                found = codestream.part2(codestream.MCT, ByteReader(body))
                out.append((k, found["index"], found["type"], found["element_type"], found["elements"]))
            names = ["k", "index", "type", "element_type", "elements"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int32())] * 5, names=names)

    return keys.mapInArrow(run, "k int, index int, type int, element_type int, elements int")
