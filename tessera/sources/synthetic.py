"""Images made here: a seeded random source, and a small encoder whose files the decoder is tested on.

The encoder writes 5/3 and 9/7 streams within the decoder's scope; it exists for fixtures and queries,
not for speed.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.bits import BitWriter
from tessera.operators import entropy, planes
from tessera.sources import boxes, codestream as cs

SEED = 12345


def random_pixels(spark: SparkSession, width: int, height: int, seed: int = SEED) -> DataFrame:
    """(y, x, pixel) of a random 24-bit image; the distribution, not the bits, of a seeded generator."""
    return spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.rand(seed) * (1 << 24)).cast("int").alias("pixel"))


def random_floats(spark: SparkSession, count: int, low: float = 0.0, high: float = 1.0, seed: int = SEED) -> DataFrame:
    """(i, v) uniform in [low, high); low = high fills with a constant."""
    return spark.range(count).select(F.col("id").alias("i"), (F.rand(seed) * (high - low) + low).alias("v"))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">HH", marker, len(body) + 2) + body


def _quantisation(h: cs.Header) -> bytes:
    """The body of a QCD or QCC."""
    if h.quant == 0:
        return bytes([h.guard << 5]) + bytes(e << 3 for e, _ in h.bands)
    return bytes([h.guard << 5 | h.quant]) + b"".join(struct.pack(">H", e << 11 | m) for e, m in h.bands)


def _coding(h: cs.Header) -> bytes:
    """What a COD and a COC have in common."""
    return bytes([h.levels, h.cblk_w.bit_length() - 3, h.cblk_h.bit_length() - 3, 0, int(h.reversible)])


def encode(
    image: np.ndarray, bits: int = 8, signed: bool = False, levels: int = 2, tile: tuple[int, int] | None = None, cblk: tuple[int, int] = (4, 4), mct: bool = False, guard: int = 2,
    sop: bool = False, eph: bool = False, reversible: bool = True, derived: bool = False, fraction: int = 6, mant: int = 0, own: dict[int, dict] | None = None, extra: bytes = b"",
) -> bytes:
    """Codestream of an integer image (components, height, width); `cblk` are exponents.

    9/7 streams are quantised in steps of (1 + mant / 2048) / 2**fraction, stated for each subband or only
    for LL (`derived`). `own` has the header's fields that are a component's own (COC, QCC); `extra` are
    segments to put into the main header.
    """
    components, height, width = image.shape
    tile_w, tile_h = tile or (width, height)
    h = cs.Header(width, height, tile_w, tile_h, components, bits, signed, levels=levels, cblk_w=1 << cblk[0], cblk_h=1 << cblk[1], use_mct=mct, guard=guard, reversible=reversible, own=own or {})
    gains = [0] + [(1, 1, 2)[k] for _ in range(levels) for k in range(3)]
    if reversible:
        h.bands = [(bits + g + (1 if mct else 0), 0) for g in gains]
    else:
        h.quant, h.bands = (1, [(bits + fraction + levels, mant)]) if derived else (2, [(bits + g + fraction, mant) for g in gains])
    depth = (bits - 1) | (128 if signed else 0)
    out = struct.pack(">H", cs.SOC)
    out += _segment(cs.SIZ, struct.pack(">HIIIIIIIIH", 0, width, height, 0, 0, tile_w, tile_h, 0, 0, components) + bytes([depth, 1, 1]) * components)
    out += _segment(cs.COD, struct.pack(">BBHB", 2 * sop | 4 * eph, 1, 1, mct) + _coding(h))
    out += _segment(cs.QCD, _quantisation(h))
    for k in h.own:
        out += _segment(cs.COC, bytes([k, 0]) + _coding(h.of(k))) + _segment(cs.QCC, bytes([k]) + _quantisation(h.of(k)))
    out += extra
    for tile_no in range(cs.ceil_div(width, tile_w) * cs.ceil_div(height, tile_h)):
        body = _tile(image, h, tile_no, sop, eph)
        out += struct.pack(">HHHIBB", cs.SOT, 10, tile_no, len(body) + 14, 0, 1) + struct.pack(">H", cs.SOD) + body
    return out + struct.pack(">H", cs.EOC)


def _coloured(part: np.ndarray, h: cs.Header) -> np.ndarray:
    if not h.use_mct:
        return part if h.reversible else part.astype(np.float64)
    r, g, b = part[:3]
    if h.reversible:
        return np.stack([(r + 2 * g + b) >> 2, b - g, r - g, *part[3:]])
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, (b - y) / 1.772, (r - y) / 1.402, *part[3:]])


def _tile(image: np.ndarray, h: cs.Header, tile_no: int, sop: bool, eph: bool) -> bytes:
    x0, y0, x1, y1 = bounds = cs.tile_bounds(h, tile_no)
    part = image[:, y0:y1, x0:x1].astype(np.int64) - (0 if h.signed else 1 << h.bits - 1)
    coded = [planes.forward(p, h.levels, h.reversible) for p in _coloured(part, h)]
    out, number = b"", 0
    for res in range(h.levels + 1):
        for k, plane in enumerate(coded):
            if sop:
                out += struct.pack(">HHH", cs.SOP, 4, number & 0xFFFF)
            number += 1
            out += _packet(plane, h.of(k), cs.bands_of(h.of(k), bounds, res), eph)
    return out


def _quantised(samples: np.ndarray, h: cs.Header, band: cs.Band) -> np.ndarray:
    if h.reversible:
        return samples
    expn, mant = h.band(band.index, band.dec_lvl)
    step = (1 + mant / 2048) * 2.0 ** (h.bits + (0, 1, 1, 2)[band.orient] - expn)
    return np.trunc(samples / step).astype(np.int64)


def _packet(plane: np.ndarray, h: cs.Header, bands: list[cs.Band], eph: bool) -> bytes:
    bits, bodies = BitWriter(), []
    bits.bit(1)
    for band in bands:
        coded, most = [], h.band(band.index, band.dec_lvl)[0] + h.guard - 1
        for block in cs.blocks_of(h, band):
            x, y = band.place[0] + block[2] - band.bounds[0], band.place[1] + block[3] - band.bounds[1]
            w, n = block[4] - block[2], block[5] - block[3]
            data = entropy.encode_block(_quantised(plane[y : y + n, x : x + w], h, band).ravel().tolist(), w, n, band.orient)
            if data[1] > most:
                raise ValueError("the samples need more bit-planes than the header gives")
            coded.append((block, data))
            band.inclusion.set(block[0], block[1], 0 if data[1] else 1)
            band.planes.set(block[0], block[1], most - data[1])
        for (i, j, *_), (data, significant, passes) in coded:
            band.inclusion.encode(bits, i, j, 1)
            if not significant:
                continue
            for k in range(1, most - significant + 2):
                band.planes.encode(bits, i, j, k)
            bits.passes(passes)
            width = max(3 + passes.bit_length() - 1, len(data).bit_length())
            bits.ones(width - (3 + passes.bit_length() - 1))
            bits.bits(len(data), width)
            bodies.append(data)
    return bits.done() + (struct.pack(">H", cs.EPH) if eph else b"") + b"".join(bodies)


def jp2(stream: bytes, width: int, height: int, components: int, bits: int = 8, signed: bool = False, long: bool = False) -> bytes:
    """A JP2 file around a codestream."""
    header = boxes.box("ihdr", struct.pack(">IIHBBBB", height, width, components, bits - 1 | (128 if signed else 0), 7, 0, 0))
    colour = boxes.box("colr", struct.pack(">BBBI", 1, 0, 0, 16 if components >= 3 else 17))
    return boxes.box("jP  ", boxes.SIGNATURE) + boxes.box("ftyp", b"jp2 \0\0\0\0jp2 ") + boxes.box("jp2h", header + colour) + boxes.box("jp2c", stream, long)
