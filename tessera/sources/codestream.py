"""Codestream markers and packets: the bytes of an image as rows of code-blocks.

Scope: one tile-part a tile, one layer, one precinct a resolution level, all components of one depth
and sampling, and the order resolution then component (position and layer are single). A component may
have code-blocks (COC) and a quantisation (QCC) of its own, but not levels or a wavelet. Segments come in
any order; those that only comment or index are passed over. Anything else raises, and so do Part-2
segments where pixels are asked for: they are parsed, but their transforms aren't applied. A truncated
stream raises Truncated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from tessera.functions.bits import BitReader, ByteReader, Truncated
from tessera.operators.tagtree import TagTree

#: Markers (fixed values).
SOC, SIZ, COD, COC, QCD, QCC, COM = 0xFF4F, 0xFF51, 0xFF52, 0xFF53, 0xFF5C, 0xFF5D, 0xFF64
SOT, SOP, EPH, SOD, EOC = 0xFF90, 0xFF91, 0xFF92, 0xFF93, 0xFFD9
ATK, ADS, MCT, MCC, MIC = 0xFF72, 0xFF73, 0xFF74, 0xFF75, 0xFF78
MARKERS = {SOC: "SOC", SIZ: "SIZ", COD: "COD", COC: "COC", QCD: "QCD", QCC: "QCC", COM: "COM", SOT: "SOT", SOP: "SOP", EPH: "EPH", SOD: "SOD", EOC: "EOC", ATK: "ATK", ADS: "ADS", MCT: "MCT", MCC: "MCC", MIC: "MIC"}
PRECINCTS, USE_SOP, USE_EPH = 1, 2, 4
#: Segments that change nothing of how an image is coded (fixed values): lengths, registration, comments.
TLM, PLM, PLT, CRG = 0xFF55, 0xFF57, 0xFF58, 0xFF63
MARKERS |= {TLM: "TLM", PLM: "PLM", PLT: "PLT", CRG: "CRG"}
HARMLESS = {"TLM", "PLM", "CRG", "COM"}
PART2 = {"MCT", "MCC", "MIC", "ATK", "ADS"}


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


@dataclass
class Header:
    """What the main header says of an image; `bands` are (exponent, mantissa) from LL on."""

    width: int = 0
    height: int = 0
    tile_w: int = 0
    tile_h: int = 0
    components: int = 0
    bits: int = 8
    signed: bool = False
    extensions: bool = False
    style: int = 0
    order: int = 0
    layers: int = 1
    use_mct: bool = False
    levels: int = 0
    cblk_w: int = 64
    cblk_h: int = 64
    reversible: bool = True
    quant: int = 0
    guard: int = 2
    bands: list[tuple[int, int]] = field(default_factory=list)
    part2: list[dict] = field(default_factory=list)
    own: dict[int, dict] = field(default_factory=dict)

    def of(self, component: int) -> Header:
        """The header as it holds for a component."""
        return replace(self, **self.own[component]) if component in self.own else self

    def band(self, index: int, dec_lvl: int) -> tuple[int, int]:
        """Exponent and mantissa of a subband, derived from LL's if only that is given."""
        if self.quant == 1:
            return self.bands[0][0] - self.levels + dec_lvl, self.bands[0][1]
        return self.bands[index]


def _siz(r: ByteReader, h: Header) -> None:
    kind = r.uint(2)
    h.extensions = bool(kind & 0x8000 and kind & 0x80 and not kind & 1)
    x1, y1, x0, y0, h.tile_w, h.tile_h, tx, ty = (r.uint(4) for _ in range(8))
    if (x0, y0, tx, ty) != (0, 0, 0, 0):
        raise ValueError("image or tile grid with an offset")
    h.width, h.height, h.components = x1, y1, r.uint(2)
    depths = {(r.uint(1), r.uint(1), r.uint(1)) for _ in range(h.components)}
    if len(depths) != 1 or next(iter(depths))[1:] != (1, 1):
        raise ValueError("components of different depth or sampling")
    depth = next(iter(depths))[0]
    h.bits, h.signed = (depth & 127) + 1, bool(depth & 128)
    if not (h.width and h.height and h.tile_w and h.tile_h):
        raise ValueError("an empty image or tile")


def _coding(r: ByteReader) -> dict:
    """Levels, code-block size and wavelet, as COD and COC have them."""
    levels, xcb, ycb, block_style, wavelet = r.uint(1), r.uint(1) + 2, r.uint(1) + 2, r.uint(1), r.uint(1)
    if block_style or xcb > 10 or ycb > 10 or xcb + ycb > 12 or levels > 32:
        raise ValueError("a block style, block size or number of levels that isn't supported")
    return {"levels": levels, "cblk_w": 1 << xcb, "cblk_h": 1 << ycb, "reversible": wavelet != 0}


def _cod(r: ByteReader) -> dict:
    style, order, layers, mct = r.uint(1), r.uint(1), r.uint(2), bool(r.uint(1))
    if style & PRECINCTS or layers != 1 or order > 1:
        raise ValueError("precincts, layers or an order that isn't supported")
    return {"style": style, "order": order, "layers": layers, "use_mct": mct} | _coding(r)


def _qcd(r: ByteReader) -> dict:
    style = r.uint(1)
    quant, guard = style & 31, style >> 5
    if quant == 0:
        bands = [(r.uint(1) >> 3, 0) for _ in range(r.left())]
    elif quant in (1, 2):
        bands = [(v >> 11, v & 0x7FF) for v in (r.uint(2) for _ in range(r.left() // 2))]
    else:
        raise ValueError(f"quantisation style {quant}")
    return {"quant": quant, "guard": guard, "bands": bands}


def _component(r: ByteReader, h: Header) -> int:
    """The component that a COC or QCC is for."""
    number = r.uint(1 if h.components < 257 else 2)
    if number >= h.components:
        raise ValueError(f"no component {number}")
    return number


def _coc(r: ByteReader) -> dict:
    if r.uint(1) & PRECINCTS:
        raise ValueError("precincts of a component")
    return _coding(r)


def _collection(r: ByteReader) -> tuple[int, list[int]]:
    """Component type and numbers: a count in the low 13 bits, 2**type bytes each."""
    head = r.uint(2)
    kind = head >> 14
    return kind, [r.uint(1 << kind) for _ in range(head & 0x1FFF)]


def _pairs(r: ByteReader) -> list[int]:
    """A counted list of 2-bit codes, four to a byte, the first in the upper bits."""
    n = r.uint(1)
    data = r.take(ceil_div(n, 4))
    return [data[k // 4] >> 2 * (3 - k % 4) & 3 for k in range(n)]


def part2(marker: int, r: ByteReader) -> dict:
    """One Part-2 segment as a record."""
    if marker == MCT:
        head = r.uint(1)
        data = r.take(r.left())
        kind = head >> 6 & 3
        return {"marker": "MCT", "index": head & 15, "type": head >> 4 & 3, "element_type": kind, "elements": len(data) >> kind, "data": data.hex()}
    if marker in (MCC, MIC):
        out = {"marker": MARKERS[marker], "index": r.uint(1), "collections": []}
        while r.left():
            kind = r.uint(1) & 3 if marker == MCC else 0
            (in_type, inputs), (out_type, outputs) = _collection(r), _collection(r)
            foot = r.uint(1)
            names = ("atk", "ads") if kind & 2 else ("matrix", "offset")
            out["collections"].append({"type": kind, "input_type": in_type, "inputs": inputs, "output_type": out_type, "outputs": outputs, names[0]: foot & 15, names[1]: foot >> 4})
        return out
    if marker == ADS:
        return {"marker": "ADS", "index": r.uint(1), "decomposition": _pairs(r), "sub_levels": _pairs(r)}
    head = r.uint(2)  # ATK
    out = {"marker": "ATK", "index": head & 15, "coeff_type": head >> 4 & 7, "filter": head >> 7 & 3, "wavelet": head >> 9 & 1, "m0": head >> 10 & 1}
    steps, per_step, out["offset"] = r.uint(1), r.uint(1), r.uint(1)
    size = 1 << out["coeff_type"]
    out["scale"] = r.take(size).hex()
    width = 1 if out["wavelet"] else size
    out["steps"] = [[r.take(width).hex() for _ in range(per_step)] for _ in range(steps)]
    out["residues"] = [r.take(size).hex() for _ in range(steps)] if out["wavelet"] else []
    return out


def segments(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(name, offset, content) of the main header's marker segments."""
    r = ByteReader(data)
    if r.uint(2) != SOC:
        raise ValueError("no SOC marker")
    yield "SOC", 0, b""
    while r.peek() != SOT:
        at, marker = r.at, r.uint(2)
        if marker < 0xFF00:
            raise ValueError(f"{marker:04x} at {at} is no marker")
        length, head = (r.uint(4), 4) if marker in (MCT, MCC, MIC, ATK, ADS) else (r.uint(2), 2)
        yield MARKERS.get(marker, f"{marker:04X}"), at, r.take(length - head)


def main_header(data: bytes) -> tuple[Header, int]:
    """The header and where the first tile starts."""
    h, end, bodies = Header(), 2, {"SIZ": [], "COD": [], "QCD": [], "COC": [], "QCC": []}
    by_name = {v: k for k, v in MARKERS.items()}
    for name, at, body in segments(data):
        if name in bodies:
            bodies[name].append(ByteReader(body))
        elif name in PART2:
            h.part2.append(part2(by_name[name], ByteReader(body)))
        elif name not in HARMLESS | {"SOC"}:
            raise ValueError(f"segment {name} isn't supported")
        end = at + 2 + (len(body) + (4 if name in PART2 else 2) if name != "SOC" else 0)
    if any(len(bodies[name]) != 1 for name in ("SIZ", "COD", "QCD")):
        raise ValueError("SIZ, COD or QCD is missing or there twice")
    _siz(bodies["SIZ"][0], h)
    h = replace(h, **_cod(bodies["COD"][0]), **_qcd(bodies["QCD"][0]))
    for name, parse in (("COC", _coc), ("QCC", _qcd)):
        for r in bodies[name]:
            h.own.setdefault(_component(r, h), {}).update(parse(r))
    for k in range(h.components) if h.own else [0]:
        own = h.of(k)
        if (own.levels, own.reversible) != (h.levels, h.reversible):
            raise ValueError("components of different levels or wavelets")
        if len(own.bands) < (1 if own.quant == 1 else 3 * h.levels + 1):
            raise ValueError("too few step sizes")
    return h, end


@dataclass
class Band:
    """A subband of a tile-component: bounds, place in the plane, grid of code-blocks."""

    orient: int
    dec_lvl: int
    index: int
    bounds: tuple[int, int, int, int]
    place: tuple[int, int]
    grid: tuple[int, int, int, int]  # first column and row, columns, rows
    inclusion: TagTree
    planes: TagTree


def tile_bounds(h: Header, tile_no: int) -> tuple[int, int, int, int]:
    p, q = tile_no % ceil_div(h.width, h.tile_w), tile_no // ceil_div(h.width, h.tile_w)
    if q * h.tile_h >= h.height:
        raise ValueError(f"no tile {tile_no}")
    return p * h.tile_w, q * h.tile_h, min((p + 1) * h.tile_w, h.width), min((q + 1) * h.tile_h, h.height)


def bands_of(h: Header, bounds: tuple[int, int, int, int], res: int) -> list[Band]:
    out = []
    level = h.levels if res == 0 else h.levels - res + 1
    scale = 1 << level
    low_w = ceil_div(bounds[2], scale) - ceil_div(bounds[0], scale)
    low_h = ceil_div(bounds[3], scale) - ceil_div(bounds[1], scale)
    for orient in (0,) if res == 0 else (1, 2, 3):
        x, y = orient & 1, orient >> 1
        half = scale // 2
        own = tuple(ceil_div(b - half * (x, y)[k % 2], scale) for k, b in enumerate(bounds))
        x0, y0 = own[0] // h.cblk_w, own[1] // h.cblk_h
        nx = ceil_div(own[2], h.cblk_w) - x0 if own[2] > own[0] else 0
        ny = ceil_div(own[3], h.cblk_h) - y0 if own[3] > own[1] else 0
        if not nx or not ny:
            nx = ny = 0
        out.append(Band(orient, level, 0 if res == 0 else 3 * (res - 1) + orient, own, (x * low_w, y * low_h), (x0, y0, nx, ny), TagTree(nx, ny), TagTree(nx, ny)))
    return out


def blocks_of(h: Header, band: Band) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(column, row, bounds) of a subband's code-blocks in raster order."""
    x0, y0, nx, ny = band.grid
    for j in range(ny):
        for i in range(nx):
            left, top = (x0 + i) * h.cblk_w, (y0 + j) * h.cblk_h
            yield i, j, max(left, band.bounds[0]), max(top, band.bounds[1]), min(left + h.cblk_w, band.bounds[2]), min(top + h.cblk_h, band.bounds[3])


def _packet(r: ByteReader, h: Header, bands: list[Band]) -> Iterator[tuple]:
    """(band, block, bounds, zero planes, passes, bytes) of a packet's included blocks."""
    if r.peek() == SOP:
        r.take(6)
    bits, included = BitReader(r), []
    if bits.bit():
        for band in bands:
            for no, block in enumerate(blocks_of(h, band)):
                i, j = block[:2]
                if not band.inclusion.decode(bits, i, j, 1):
                    included.append((band, no, block, None, 0, 0))
                    continue
                zero = 0
                while not band.planes.decode(bits, i, j, zero + 1):
                    zero += 1
                    if zero > 64:
                        raise ValueError("no end of zero bit-planes")
                passes = bits.passes()
                width = 3 + bits.ones() + passes.bit_length() - 1
                included.append((band, no, block, zero, passes, bits.bits(width)))
    bits.align()
    if r.peek() == EPH:
        r.take(2)
    for band, no, block, zero, passes, length in included:
        yield band, no, block, zero, passes, r.take(length)


def codeblocks(data: bytes, max_res: int | None = None) -> Iterator[dict]:
    """Every included code-block of a codestream, tile by tile, resolution by resolution.

    After a tile's blocks comes a row for the tile itself, without bytes and of no size, so that a tile
    is there even if none of its blocks is coded.
    """
    h, at = main_header(data)
    if h.part2 or h.extensions:
        raise ValueError("Part-2 transforms aren't applied")
    r, seen = ByteReader(data, at), set()
    for_component = [h.of(k) for k in range(h.components)]
    while r.peek() == SOT:
        start = r.at
        r.take(4)
        tile_no, length, part, _ = r.uint(2), r.uint(4), r.uint(1), r.uint(1)
        if part or tile_no in seen:
            raise ValueError("more than one part of a tile")
        seen.add(tile_no)
        while r.peek() != SOD:  # a tile's own segments must not change the coding
            marker = r.uint(2)
            if marker not in (COM, PLT):
                raise ValueError(f"{MARKERS.get(marker, hex(marker))} in a tile header")
            r.take(r.uint(2) - 2)
        r.take(2)
        bounds = tile_bounds(h, tile_no)
        tile = {
            "tile_no": tile_no, "tlx": bounds[0], "tly": bounds[1], "tile_w": bounds[2] - bounds[0], "tile_h": bounds[3] - bounds[1], "width": h.width, "height": h.height, "components": h.components,
            "bits": h.bits, "signed": h.signed, "levels": h.levels, "reversible": h.reversible, "use_mct": h.use_mct,
        }
        for res in range(h.levels + 1):
            for comp, own in enumerate(for_component):
                bands = bands_of(own, bounds, res)
                for band, no, block, zero, passes, body in _packet(r, own, bands):
                    if zero is None or max_res is not None and res > max_res:
                        continue
                    expn, mant = own.band(band.index, band.dec_lvl)
                    yield tile | {
                        "comp_no": comp, "res_no": res, "dec_lvl_no": band.dec_lvl, "orient": band.orient, "cblk_no": no,
                        "x": band.place[0] + block[2] - band.bounds[0], "y": band.place[1] + block[3] - band.bounds[1], "w": block[4] - block[2], "h": block[5] - block[3],
                        "expn": expn, "mant": mant, "mag_bits": expn + own.guard - 1, "significant_bits": expn + own.guard - 1 - zero, "passes": passes, "bytes": body,
                    }
        if length and r.at > start + length:
            raise ValueError(f"tile {tile_no} is longer than it says")
        yield tile | {"w": 0, "h": 0}
        r.at = start + length if length else r.at
    if r.peek() not in (EOC, -1):
        raise ValueError(f"{r.peek():04x} after a tile")
    if len(seen) != ceil_div(h.width, h.tile_w) * ceil_div(h.height, h.tile_h):
        raise Truncated("tiles are missing")
