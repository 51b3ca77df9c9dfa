import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import bits, lifting
from tessera.operators import planes, quant
from tessera.operators.tagtree import TagTree
from tessera.plans import decode
from tessera.sources import boxes, codestream, options, sinks, synthetic


def image(components, height, width, seed=0, signed=False):
    base = np.random.default_rng(seed).integers(0, 256, (components, height, width))
    return base - 128 if signed else base


CASES = [
    (image(1, 8, 8), {"levels": 1}),
    (image(3, 40, 37), {"levels": 3, "tile": (16, 24), "mct": True, "eph": True}),
    (image(1, 13, 21, signed=True), {"signed": True, "levels": 2, "sop": True}),
    (image(2, 5, 1), {"levels": 0}),
    (image(1, 1, 9), {"levels": 2, "cblk": (3, 2)}),
]


def to_file(pixels, how, **more):
    return synthetic.jp2(synthetic.encode(pixels, **how), pixels.shape[2], pixels.shape[1], len(pixels), signed=how.get("signed", False), **more)


def test_decode_images(spark):
    files = [(k, to_file(p, how, long=k % 2 == 1)) for k, (p, how) in enumerate(CASES)]
    files += [(90, synthetic.encode(*CASES[0][:1], **CASES[0][1])), (91, b"neither"), (92, files[1][1][:400]), (93, None), (94, b"")]
    frame = spark.createDataFrame(files, "image_id long, content binary").repartition(3)
    got = {}
    for r in decode.pixels(decode.decode_images(frame)).collect():
        got.setdefault(r.image_id, {})[r.comp_no, r.y, r.x] = r.v
    for k, (p, _) in enumerate([*CASES]):
        assert got[k] == {(c, y, x): int(p[c, y, x]) for c in range(p.shape[0]) for y in range(p.shape[1]) for x in range(p.shape[2])}, k
    assert got[90] == got[0] and not {91, 93, 94} & set(got)
    errors = {r.image_id for r in decode.parse(frame).filter("error IS NOT NULL").collect()}
    assert errors == {91, 92, 93, 94}


def test_lower_resolution(spark):
    flat = np.full((1, 32, 32), 77)
    frame = spark.createDataFrame([(1, to_file(flat, {"levels": 3}))], "image_id int, content binary")
    got = decode.pixels(decode.decode_images(frame, max_res=1)).collect()
    assert len(got) == 64 and {r.v for r in got} == {77}


def test_tiles_without_coded_blocks(spark):
    """Samples of mid-grey are zeros after the level shift, and no block of zeros is included."""
    grey, half = np.full((3, 20, 24), 128), np.full((1, 32, 32), 128)
    half[0, :16, :16] = image(1, 16, 16)[0]
    checked = 128 + 100 * (-1) ** np.add.outer(np.arange(8), np.arange(8))[None]  # its blocks lie above resolution 0
    files = [(1, to_file(grey, {"levels": 2, "tile": (16, 16), "mct": True})), (2, to_file(half, {"levels": 2, "tile": (16, 16)})), (3, to_file(checked, {"levels": 1})), (4, to_file(np.zeros((1, 6, 5), int), {"levels": 1, "signed": True}))]
    frame = spark.createDataFrame(files, "image_id int, content binary")

    def decoded(max_res=None):
        got = {}
        for r in decode.pixels(decode.decode_images(frame, max_res)).collect():
            got.setdefault(r.image_id, {})[r.comp_no, r.y, r.x] = r.v
        return got

    full = decoded()
    for k, p in ((1, grey), (2, half), (3, checked), (4, np.zeros((1, 6, 5)))):
        assert full[k] == {c: int(v) for c, v in np.ndenumerate(p)}, k
    assert decoded(0)[3] == {(0, y, x): 128 for y in range(4) for x in range(4)}
    sizes = {r.image_id: len(r.content) for r in sinks.bmp_images(decode.decode_images(frame.filter("image_id < 3"))).collect()}
    assert sizes == {1: 54 + 4 * 20 * 24, 2: 54 + 4 * 32 * 32}


def test_damaged_files_give_no_pixels(spark):
    """Also where some tiles are whole: cut in a later tile, a tile that is missing, a segment in the wrong place."""
    whole = synthetic.encode(image(1, 32, 32), levels=2, tile=(16, 16))
    second = whole.index(b"\xff\x90", whole.index(b"\xff\x90") + 2)
    cut = [whole[:-3], whole[: second + 40], whole[:second] + b"\xff\xd9", whole[:second] + b"\xff\x5e\x00\x03\x00" + whole[second:]]
    frame = spark.createDataFrame([*enumerate(cut), (9, whole)], "image_id int, content binary")
    rows = decode.parse(frame).collect()
    assert sorted(r.image_id for r in rows if r.error) == [0, 1, 2, 3] and {r.image_id for r in rows if not r.error} == {9}
    assert {r.image_id for r in decode.decode_images(frame).collect()} == {9}


def segment(marker, body):
    return struct.pack(">HH", marker, len(body) + 2) + body


def test_segments_of_the_main_header(spark):
    """Harmless ones are passed over; those that change the coding, and all unknown ones, refuse the file."""
    pixels = image(1, 12, 10)
    good = {0xFF64: b"\0\1a comment", 0xFF63: b"\0\0\0\0", 0xFF55: b"\0\x50\0\0\0\0", 0xFF57: b"\0\0"}
    bad = {0xFF5E: b"\0\0\1", 0xFF5F: b"\0\0\0\1\1\0\0", 0xFF60: b"\0", 0xFF61: b"\0", 0xFF50: b"\0\0\0\0", 0xFF77: b"\0\0"}
    files = [(k, synthetic.encode(pixels, extra=segment(m, body))) for k, (m, body) in enumerate((good | bad).items())]
    got = {}
    for r in decode.decode_images(spark.createDataFrame(files, "image_id int, content binary")).collect():
        got.setdefault(r.image_id, {})[r.y] = r.samples
    assert set(got) == set(range(len(good)))
    assert all([lines[y] for y in range(12)] == pixels[0].tolist() for lines in got.values())


def test_part2_files_are_parsed_but_not_decoded():
    mct = struct.pack(">HI", codestream.MCT, 4 + 5) + bytes([1 << 6 | 2, 0, 1, 0, 2])
    stream = synthetic.encode(image(1, 8, 8), extra=mct)
    assert codestream.main_header(stream)[0].part2[0]["elements"] == 2
    extended = stream.replace(mct, b"").replace(b"\xff\x51\x00\x29\x00\x00", b"\xff\x51\x00\x29\x81\x00")
    assert codestream.main_header(extended)[0].extensions is False  # 0x80 of the low byte says that transforms are used
    flagged = stream.replace(mct, b"").replace(b"\xff\x51\x00\x29\x00\x00", b"\xff\x51\x00\x29\x80\x80")
    for one in (stream, flagged):
        with pytest.raises(ValueError, match="Part-2"):
            list(codestream.codeblocks(one))


def test_components_of_their_own_coding(spark):
    """COC and QCC: other block sizes, guard bits and exponents for one component."""
    pixels = image(3, 30, 34)
    bands = [(12, 0)] * 7
    stream = synthetic.encode(pixels, levels=2, own={1: {"cblk_w": 8, "cblk_h": 4, "guard": 3, "bands": bands}, 2: {"bands": [(11, 0)] * 7}})
    h, _ = codestream.main_header(stream)
    assert (h.of(1).cblk_w, h.of(1).cblk_h, h.of(1).guard, h.of(1).bands) == (8, 4, 3, bands) and h.of(0) is h and h.of(2).guard == 2
    got = {(r.comp_no, r.y): r.samples for r in decode.decode_images(spark.createDataFrame([(1, stream)], "image_id int, content binary")).collect()}
    assert got == {(c, y): pixels[c, y].tolist() for c in range(3) for y in range(30)}
    coc = lambda k, levels, wavelet=1: segment(codestream.COC, bytes([k, 0, levels, 2, 2, 0, wavelet]))
    for extra in (coc(0, 1), coc(0, 2, 0), coc(3, 2), segment(codestream.QCC, b"\0\x40\x40"), segment(codestream.COC, bytes([0, 1, 2, 2, 2, 0, 1, 255])), segment(codestream.QCD, b"\x40" + b"\x40" * 7)):
        with pytest.raises(ValueError):
            list(codestream.codeblocks(synthetic.encode(pixels, levels=2, extra=extra)))


LOSSY = [
    (image(1, 16, 16, 1), {"levels": 1}),
    (image(3, 37, 50, 2), {"levels": 3, "tile": (24, 20), "mct": True}),
    (image(3, 20, 9, 3), {"levels": 2, "mct": True, "derived": True, "fraction": 7}),
    (image(1, 33, 1, 4, signed=True), {"levels": 2, "signed": True, "mant": 1000}),
    (image(2, 1, 40, 5), {"levels": 2, "derived": True, "mant": 37, "fraction": 7}),
    (image(1, 9, 9, 6), {"levels": 0}),
]


def test_lossy_images(spark):
    """9/7 streams with steps so fine that rounding gives the samples back; all three quantisation styles."""
    files = [(k, to_file(p, how | {"reversible": False})) for k, (p, how) in enumerate(LOSSY)]
    got = {}
    for r in decode.pixels(decode.decode_images(spark.createDataFrame(files, "image_id int, content binary"))).collect():
        got.setdefault(r.image_id, {})[r.comp_no, r.y, r.x] = r.v
    for k, (p, _) in enumerate(LOSSY):
        assert got[k] == {c: int(v) for c, v in np.ndenumerate(p)}, k
    coarse = synthetic.encode(LOSSY[1][0], levels=2, mct=True, reversible=False, fraction=-1)
    rows = decode.decode_images(spark.createDataFrame([(1, coarse)], "image_id int, content binary")).collect()
    errors = np.abs(np.array([r.samples for r in sorted(rows, key=lambda r: (r.comp_no, r.y))]).reshape(LOSSY[1][0].shape) - LOSSY[1][0])
    assert 0 < errors.mean() < 6


def test_truncated_streams_raise():
    stream = synthetic.encode(image(1, 16, 16), levels=2)
    for cut in range(0, len(stream) - 2, 3):
        with pytest.raises(ValueError):
            list(codestream.codeblocks(stream[:cut]))
    rng = random.Random(0)
    for _ in range(200):
        broken = bytearray(stream)
        broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
        try:
            for r in codestream.codeblocks(bytes(broken)):
                assert r["w"] >= 0
        except ValueError:
            pass


def test_boxes(spark):
    good = to_file(image(1, 8, 8), {"levels": 1})
    kinds = [b[1] for b in boxes.parse(good)]
    assert kinds == ["jP  ", "ftyp", "jp2h", "ihdr", "colr", "jp2c"]
    to_end = good[: good.index(b"jp2c") - 4] + struct.pack(">I", 0) + good[good.index(b"jp2c") :]
    assert boxes.codestream(to_end) == boxes.codestream(good) == boxes.codestream(to_file(image(1, 8, 8), {"levels": 1}, long=True))
    for bad in (good[:30], good.replace(b"ftypjp2 ", b"ftypjpx "), good[12:], good.replace(b"ihdr", b"xxxx"), good.replace(b"jp2c", b"jp2x")):
        with pytest.raises(ValueError):
            boxes.codestream(bad)
    rows = boxes.boxes(spark.createDataFrame([("a", good), ("b", good[:50]), ("c", None), ("d", b"")], "path string, content binary")).collect()
    assert [r.type for r in rows if r.path == "a"] == kinds
    assert [r.error is not None for r in rows if r.path == "b"][-1] and {r.path for r in rows} == {"a", "b"}
    header = boxes.image_headers(spark.createDataFrame([("a", good)], "path string, content binary").transform(boxes.boxes)).first()
    assert (header.height, header.width, header.components, header.bits, header.signed) == (8, 8, 1, 8, False)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 16, 17])
def test_lifting(spark, n):
    rng = np.random.default_rng(n)
    ints, floats = rng.integers(-99, 99, n), rng.normal(size=n)
    frame = spark.createDataFrame([(ints.tolist(), floats.tolist())], "i array<int>, f array<double>")
    r = frame.select(lifting.inverse53(F.col("i")).alias("a"), lifting.forward53(F.col("i")).alias("b"), lifting.inverse97(F.col("f")).alias("c")).first()
    assert r.a == planes._inverse53(ints).tolist() and r.b == planes._forward53(ints).tolist()
    assert np.allclose(r.c, planes._inverse97(floats), atol=1e-12)
    assert np.allclose(planes._inverse97(planes._forward97(floats)), floats, atol=1e-8)
    assert planes._inverse53(planes._forward53(ints)).tolist() == ints.tolist()


def test_published_lines(spark):
    """Forward 5/3 of two short signals."""
    rows = [([12, 15, 9, -3, -7, 0, 4, 20],), ([12, 15, 9, -3, -7, 0, 4, 20, 31],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<int>").coalesce(1).select(lifting.forward53(F.col("v"))).collect()]
    assert got == [[15, 9, -7, 9, 5, -4, 2, 16], [15, 9, -7, 5, 33, 5, -4, 2, 3]]


def test_levels(spark):
    plane = np.random.default_rng(0).integers(-50, 50, (13, 21))
    got = lifting.inverse_levels(spark.createDataFrame([(plane.tolist(),)], "p array<array<int>>"), "p", 3).first()[0]
    assert got == planes.inverse(plane, 3, True).tolist()


def test_bit_reader_and_writer():
    rng = random.Random(2)
    items = [rng.choice([("bits", rng.getrandbits(9), 9), ("ones", rng.randint(0, 20)), ("passes", rng.randint(1, 164))]) for _ in range(400)] + [("bits", 0xFFFF, 16)] * 9
    out = bits.BitWriter()
    for kind, *args in items:
        getattr(out, kind)(*args)
    data = out.done()
    reader = bits.BitReader(bits.ByteReader(data + b"\xaa"))
    for kind, *args in items:
        if kind == "bits":
            assert reader.bits(args[1]) == args[0]
        else:
            assert getattr(reader, kind)() == args[0]
    reader.align()
    assert reader.source.take(1) == b"\xaa"
    with pytest.raises(bits.Truncated):
        reader.source.take(1)


def test_exploded_bytes(spark):
    rows = [(k, bytes(range(250, 256)) * 3 + bytes(range(k))) for k in range(9)] + [(90, b""), (91, None)]
    frame = spark.createDataFrame(rows, "k int, data binary")
    got = {}
    for r in bits.explode_bytes(frame, ["k"], "data").collect():
        got.setdefault(r.k, {})[r.i] = r.b
    assert got == {k: dict(enumerate(d)) for k, d in rows if d}
    assert {r.k: r.b for r in frame.select("k", bits.bytes_of(F.col("data")).alias("b")).collect()} == {k: None if d is None else list(d) for k, d in rows}


def test_tag_tree():
    rng = random.Random(3)
    for w, h in ((1, 1), (3, 5), (8, 2)):
        leaves = {(x, y): rng.randint(0, 6) for x in range(w) for y in range(h)}
        tree, out = TagTree(w, h), bits.BitWriter()
        for (x, y), v in leaves.items():
            tree.set(x, y, v)
        asked = [(x, y, t) for t in range(1, 8) for x, y in leaves]
        for x, y, t in asked:
            tree.encode(out, x, y, t)
        back, reader = TagTree(w, h), bits.BitReader(bits.ByteReader(out.done()))
        assert [back.decode(reader, x, y, t) for x, y, t in asked] == [leaves[x, y] < t for x, y, t in asked]


def test_part2_segments():
    r = lambda text: bits.ByteReader(bytes.fromhex(text))
    assert codestream.part2(codestream.ADS, r("03 05 1B40 02 80"))["decomposition"] == [0, 1, 2, 3, 1]
    assert codestream.part2(codestream.ADS, r("03 05 1B40 02 80"))["sub_levels"] == [2, 0]
    mcc = codestream.part2(codestream.MCC, r("07 01 0002 0001 4001 0005 21 02 0001 09 0001 08 43"))
    assert mcc["index"] == 7 and mcc["collections"][0] == {"type": 1, "input_type": 0, "inputs": [0, 1], "output_type": 1, "outputs": [5], "matrix": 1, "offset": 2}
    assert mcc["collections"][1]["atk"] == 3 and mcc["collections"][1]["ads"] == 4
    mic = codestream.part2(codestream.MIC, r("01 0001 00 0001 02 10"))
    assert mic["collections"][0]["outputs"] == [2]
    atk = codestream.part2(codestream.ATK, r("0612 01 02 00 00112233 0A 0B AABBCCDD"))
    assert (atk["index"], atk["coeff_type"], atk["wavelet"], atk["m0"]) == (2, 1, 1, 1)
    with pytest.raises(bits.Truncated):
        codestream.part2(codestream.MIC, r("01 0005 00"))


def test_headers_in_any_order_and_styles():
    stream = synthetic.encode(image(1, 8, 8), levels=1)
    parts = {name: stream[at : at + 4 + len(body) - 0] for name, at, body in codestream.segments(stream) if name != "SOC"}
    head = stream[:2] + parts["QCD"] + parts["COD"] + parts["SIZ"]
    h, at = codestream.main_header(head + b"\xff\x90")
    assert (h.width, h.levels, len(h.bands), at) == (8, 1, 4, len(head))
    derived = codestream.Header(levels=3, quant=1, bands=[(9, 100)])
    assert [derived.band(0, k) for k in (3, 1)] == [(9, 100), (7, 100)]


def test_distortion(spark):
    """By counting planes sample by sample, and the weights as published in the table."""
    values = [0, 1, -1, 2, 3, -4, 255, -256, 1000]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).select(quant.coded_distortion(F.col("v"))).collect()]
    assert got == [-float(sum(4**p for p in range(abs(v).bit_length()))) for v in values]
    rows = [(lossless, level, orient) for lossless in (True, False) for level in (1, 2, 3, 4, 7) for orient in range(4)]
    frame = spark.createDataFrame(rows, "reversible boolean, level int, orient int").coalesce(1)
    weights = [r[0] for r in frame.select(quant.distortion_weight(F.col("reversible"), F.col("level"), F.col("orient"), F.lit(0.5), F.lit(4), F.lit(2))).collect()]
    for (lossless, level, orient), w in zip(rows, weights, strict=True):
        side = {1: 0.1 if lossless else 0.01, 2: 0.2, 3: 0.4}.get(level, 0.8)
        assert w == pytest.approx((1.0, side, side, side / 2)[orient] * 0.25 / 8)


def test_irreversible_tile():
    import pyarrow as pa

    plane = np.random.default_rng(4).normal(size=(16, 16)) * 40
    coded = plane.copy()
    line = planes._forward97
    coded = line(line(coded.T).T)
    rows = []
    for orient, (x, y) in enumerate(((0, 0), (8, 0), (0, 8), (8, 8))):
        expn, mag_bits = 10, 18
        step = 2.0 ** (8 + (0, 1, 1, 2)[orient] - expn) / 2.0 ** (31 - mag_bits)
        q = np.trunc(coded[y : y + 8, x : x + 8] / step).astype(np.int64)
        samples = np.where(q < 0, -q - 0x80000000, q).ravel().tolist()
        rows.append({"image_id": 1, "tile_no": 0, "comp_no": 0, "res_no": int(orient > 0), "dec_lvl_no": 1, "orient": orient, "x": x, "y": y, "w": 8, "h": 8, "expn": expn, "mant": 0, "mag_bits": mag_bits, "samples": samples, "levels": 1, "reversible": False, "use_mct": False, "bits": 8, "signed": True, "components": 1, "tile_w": 16, "tile_h": 16, "tlx": 0, "tly": 0})
    out = decode._tile(pa.Table.from_pylist(rows), None)
    got = np.array(out.column("samples").to_pylist())
    assert np.abs(got - np.clip(np.floor(plane + 0.5), -128, 127)).max() <= 1


def test_lossy_expression(spark):
    r = spark.createDataFrame([(-2147483648 + 640, 0.5, 640)], "v int, f double, w int").select(quant.lossy(F.col("v"), F.col("f")), quant.lossless(F.col("v"), F.lit(2)), quant.lossless(F.col("w"), F.lit(2))).first()
    assert tuple(r) == (-320.0, -160, 160)


def test_sinks(spark, tmp_path):
    pixels = image(3, 5, 4)
    frame = spark.createDataFrame([("a", to_file(pixels, {"levels": 1}))], "image_id string, content binary")
    content = sinks.bmp_images(decode.decode_images(frame)).first().content
    size, _, _, offset, _, w, h, _, depth = struct.unpack("<IHHIIiiHH", bytes(content[2:30]))
    assert (size, w, h, depth) == (len(content), 4, 5, 32)
    top = np.frombuffer(bytes(content[offset:]), "<u4").reshape(5, 4)[-1]
    assert ((top >> 16) & 255).tolist() == pixels[0, 0].tolist() and (top & 255).tolist() == pixels[2, 0].tolist()
    done = sinks.write_files(spark.createDataFrame([("x.bin", b"abc"), ("y.bin", None)], "name string, content binary"), str(tmp_path / "out")).collect()
    assert sorted(map(tuple, done)) == [("x.bin", 3), ("y.bin", 0)] and (tmp_path / "out/x.bin").read_bytes() == b"abc"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.any").write_bytes(to_file(pixels, {"levels": 1}))
    read = decode.read_files(spark, str(tmp_path / "in"))
    assert decode.pixels(decode.decode_images(read)).count() == 60


def test_options():
    more = options.parse("tile_w = 64\n  128 ; set in\n; no\n# no\nno pair here\ntile_h = 9x\nbp = x\nlevels\n[tile_h = 3]\n  device = 2\ntarget_size=-3.7")
    assert (more.tile_w, more.tile_h, more.bp, more.device, more.target_size) == (128, 9, 0.0, 2, -3)
    got = options.parse("tile_w = 64 ; comment\n[x]\n  tile_h: -1\nbp=1.5\nunknown=3\nmct_klt_err = 1e-3\n")
    assert (got.tile_w, got.tile_h, got.bp, got.mct_klt_err, got.tile_comp_dlvls) == (64, None, 1.5, 1e-3, 4)
    assert options.parse("") == options.parse(None) == options.Options()
