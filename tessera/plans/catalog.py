"""The registered queries of the raster engine and the SQL each must agree with.

Keys name the operator they apply. Rasters are views of the test tables (`sources.views`); every query
runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bits, lifting
from tessera.operators import color, geometry, quant, tagtree
from tessera.plans import decode, trials
from tessera.sources import boxes, sinks, synthetic, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


# Views in SQL.
E = "e AS (SELECT vec_id AS y, unnest(range(64))::INT AS x, floor(unnest(embedding)::DOUBLE * 128)::INT AS q FROM embeddings)"
O = "o AS (SELECT o_orderkey AS k, (o_custkey % 256)::INT AS r, (floor(o_totalprice)::BIGINT % 256)::INT AS g, (o_orderkey % 256)::INT AS b FROM orders)"  # noqa: E741
I = "i AS (SELECT n_nationkey AS image_id, 640 + 37 * n_nationkey AS w, 480 + 23 * n_nationkey AS h, 256 AS tw, 192 AS th FROM nation)"  # noqa: E741
P = """p AS (SELECT p_partkey AS k, p_size AS size, (1 + p_size % 32)::INT AS w, (1 + p_partkey % 64)::INT AS h,
  (CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 2654435761) % 2147483648 - 2147483648 ELSE (p_partkey * 2654435761) % 2147483648 END)::INT AS v,
  (8 + p_size % 16)::INT AS planes, (p_size % 16)::INT AS expn, (p_partkey % 2048)::INT AS mant, (p_partkey % 4)::INT AS orient,
  (1 + p_partkey % 3)::INT AS dec_lvl, (p_size % 8)::INT AS zero, p_partkey // 64 AS tile FROM part)"""
T = """t AS (SELECT image_id, tile_no, tile_no % nx AS p, tile_no // nx AS q, (tile_no % nx) * tw AS tlx, (tile_no // nx) * th AS tly,
  least((tile_no % nx + 1) * tw, w) AS brx, least((tile_no // nx + 1) * th, h) AS bry
  FROM (SELECT *, unnest(range(nx * ny)) AS tile_no FROM (SELECT *, (w + tw - 1) // tw AS nx, (h + th - 1) // th AS ny FROM i)))"""
C = "c AS (SELECT *, unnest(range(3))::INT AS comp_no, 2 AS num_dlvls, 64 AS cblk_w, 64 AS cblk_h FROM t)"
B = """b0 AS (SELECT *, CASE WHEN res_no = 0 THEN num_dlvls ELSE num_dlvls - res_no + 1 END AS dec_lvl_no
  FROM (SELECT *, unnest(CASE WHEN res_no = 0 THEN [0] ELSE [1, 2, 3] END)::INT AS orient FROM (SELECT *, unnest(range(num_dlvls + 1))::INT AS res_no FROM c))),
b1 AS (SELECT * REPLACE (dec_lvl_no::INT AS dec_lvl_no), (1 << dec_lvl_no)::BIGINT AS s, (1 << dec_lvl_no)::BIGINT // 2 AS half, orient & 1 AS xh, orient >> 1 AS yh FROM b0),
b2 AS (SELECT image_id, tile_no, comp_no, res_no, orient, dec_lvl_no, cblk_w, cblk_h,
  (tlx - half * xh + s - 1) // s AS tlx, (tly - half * yh + s - 1) // s AS tly, (brx - half * xh + s - 1) // s AS brx, (bry - half * yh + s - 1) // s AS bry,
  xh * ((brx + s - 1) // s - (tlx + s - 1) // s) AS px, yh * ((bry + s - 1) // s - (tly + s - 1) // s) AS py FROM b1),
b AS (SELECT *, tlx // cblk_w AS cb0x, tly // cblk_h AS cb0y, CASE WHEN brx > tlx THEN (brx + cblk_w - 1) // cblk_w - tlx // cblk_w ELSE 0 END AS num_xcblks,
  CASE WHEN bry > tly THEN (bry + cblk_h - 1) // cblk_h - tly // cblk_h ELSE 0 END AS num_ycblks FROM b2)"""


def _lift_sql(source: str, name: str, keys: str, pos: str, value: str, steps: list[tuple[int, str]], scale: tuple[str, str] = ("1", "1")) -> str:
    """CTEs that interleave the bands of lines and apply lifting steps of (parity, expression in own and s)."""
    out = f"""{name}_0 AS (SELECT * REPLACE (CASE WHEN {pos} < nl THEN 2 * {pos} ELSE 2 * ({pos} - nl) + 1 END AS {pos}, CASE WHEN n = 1 THEN {value} WHEN {pos} < nl THEN {value} * {scale[0]} ELSE {value} / {scale[1]} END AS {value})
  FROM (SELECT *, (n + 1) // 2 AS nl FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {source})))"""
    if scale == ("1", "1"):
        out = out.replace(f"CASE WHEN n = 1 THEN {value} WHEN {pos} < nl THEN {value} * 1 ELSE {value} / 1 END", value)
    for k, (parity, change) in enumerate(steps, 1):
        out += f""",
{name}_{k} AS (SELECT * EXCLUDE (l, r) REPLACE (CASE WHEN n > 1 AND {pos} % 2 = {parity} THEN {change.format(v=value, s="(coalesce(l, r) + coalesce(r, l))")} ELSE {value} END AS {value})
  FROM (SELECT *, lag({value}) OVER w AS l, lead({value}) OVER w AS r FROM {name}_{k - 1} WINDOW w AS (PARTITION BY {keys} ORDER BY {pos})))"""
    return out + f",\n{name} AS (SELECT * EXCLUDE (n, nl) FROM {name}_{len(steps)})"


INV53 = [(0, "{v} - (({s} + 2) >> 2)"), (1, "{v} + ({s} >> 1)")]
INV97 = [(p, "{v} + (" + repr(a) + "::DOUBLE) * {s}") for p, a in ((0, lifting.A4), (1, lifting.A3), (0, lifting.A2), (1, lifting.A1))]
SCALE97 = (f"({lifting.K!r}::DOUBLE)",) * 2


def _levels_sql(levels: int) -> str:
    """5/3 over the tiles of e, level by level; ends in a view `done`. Each level names the one above twice, hence MATERIALIZED."""
    out = "lv AS MATERIALIZED (SELECT y // 64 AS tile, y % 64 AS j, x, q AS v, count(*) OVER (PARTITION BY y // 64, x) AS th FROM e)"
    source = "lv"
    for level in reversed(range(levels)):
        s = 1 << level
        out += f",\nin{level} AS MATERIALIZED (SELECT * FROM {source} WHERE j < (th + {s - 1}) // {s} AND x < {-(-64 // s)}),\n"
        out += _lift_sql(f"in{level}", f"c{level}", "tile, x", "j", "v", INV53) + ",\n" + _lift_sql(f"c{level}", f"r{level}", "tile, j", "x", "v", INV53)
        out += f",\nout{level} AS MATERIALIZED (SELECT * FROM r{level} UNION ALL BY NAME SELECT * FROM {source} WHERE NOT (j < (th + {s - 1}) // {s} AND x < {-(-64 // s)}))"
        source = f"out{level}"
    return out + f",\ndone AS (SELECT tile * 64 + j AS y, x::INT AS x, v::INT AS v FROM {source})"


# Geometry.


@query(f"WITH {I}, {T} SELECT * FROM t")
def tile_grid(spark, sf_dir):
    return geometry.tiles(views.images(spark, sf_dir))


def _components(spark, sf_dir):
    return geometry.tile_components(geometry.tiles(views.images(spark, sf_dir)))


@query(f"WITH {I}, {T}, {C} SELECT * FROM c")
def tile_components(spark, sf_dir):
    return _components(spark, sf_dir)


@query(
    f"""WITH {I}, {T}, {C}, r AS (SELECT *, unnest(range(num_dlvls + 1))::INT AS res_no FROM c), s AS (SELECT *, (1 << (num_dlvls - res_no))::BIGINT AS z FROM r)
SELECT image_id, tile_no, comp_no, res_no, (CASE WHEN res_no = 0 THEN num_dlvls ELSE num_dlvls - res_no + 1 END)::INT AS dec_lvl_no, (CASE WHEN res_no = 0 THEN 1 ELSE 3 END)::INT AS num_subbands,
  (tlx + z - 1) // z AS tlx, (tly + z - 1) // z AS tly, (brx + z - 1) // z AS brx, (bry + z - 1) // z AS bry FROM s"""
)
def resolution_levels(spark, sf_dir):
    return geometry.resolution_levels(_components(spark, sf_dir)).select("image_id", "tile_no", "comp_no", "res_no", "dec_lvl_no", "num_subbands", "tlx", "tly", "brx", "bry")


@query(f"WITH {I}, {T}, {C}, {B} SELECT image_id, tile_no, comp_no, res_no, orient, dec_lvl_no, tlx, tly, brx, bry, px, py, num_xcblks, num_ycblks FROM b")
def subband_layout(spark, sf_dir):
    return geometry.subbands(_components(spark, sf_dir)).select("image_id", "tile_no", "comp_no", "res_no", "orient", "dec_lvl_no", "tlx", "tly", "brx", "bry", "px", "py", "num_xcblks", "num_ycblks")


@query(
    f"""WITH {I}, {T}, {C}, {B}, g AS (SELECT *, unnest(range(num_xcblks * num_ycblks)) AS cblk_no FROM b), n AS (SELECT *, cblk_no % num_xcblks AS no_x, cblk_no // num_xcblks AS no_y FROM g)
SELECT image_id, tile_no, comp_no, res_no, orient, cblk_no, no_x, no_y, greatest((cb0x + no_x) * cblk_w, tlx) AS c_tlx, greatest((cb0y + no_y) * cblk_h, tly) AS c_tly,
  least((cb0x + no_x + 1) * cblk_w, brx) AS c_brx, least((cb0y + no_y + 1) * cblk_h, bry) AS c_bry FROM n"""
)
def codeblock_grid(spark, sf_dir):
    return geometry.codeblocks(geometry.subbands(_components(spark, sf_dir))).select("image_id", "tile_no", "comp_no", "res_no", "orient", "cblk_no", "no_x", "no_y", "c_tlx", "c_tly", "c_brx", "c_bry")


# Wavelets.


def _row_samples(lines, value):
    return lines.select("y", F.posexplode(value).alias("x", "v"))


@query(f"WITH {E}, {_lift_sql('e', 'd', 'y', 'x', 'q', INV53)} SELECT y, x::INT AS x, q::INT AS v FROM d")
def iwt53_row(spark, sf_dir):
    return _row_samples(views.lines(spark, sf_dir), lifting.inverse53(F.col("q")))


@query(f"WITH {E}, g AS (SELECT y // 64 AS tile, y % 64 AS j, x, q FROM e), {_lift_sql('g', 'd', 'tile, x', 'j', 'q', INV53)} SELECT tile * 64 + j AS y, x, q::INT AS v FROM d")
def iwt53_col(spark, sf_dir):
    return views.samples(views.tile_planes(spark, sf_dir).withColumn("plane", lifting.inverse53(F.col("plane"), lifting.Rows)))


@query(f"WITH {E}, {_levels_sql(1)} SELECT * FROM done")
def iwt53_2d(spark, sf_dir):
    return views.samples(views.tile_planes(spark, sf_dir).withColumn("plane", lifting.inverse_plane(F.col("plane"))))


@query(f"WITH {E}, {_levels_sql(3)} SELECT * FROM done")
def iwt53_multilevel(spark, sf_dir):
    return views.samples(lifting.inverse_levels(views.tile_planes(spark, sf_dir), "plane", 3))


@query(f"WITH {E} SELECT y, x, q AS v FROM e")
def fwt53_roundtrip(spark, sf_dir):
    return views.samples(views.tile_planes(spark, sf_dir).withColumn("plane", lifting.forward_plane(F.col("plane"))).withColumn("plane", lifting.inverse_plane(F.col("plane"))))


def _doubles(column):
    return F.transform(column, lambda row: F.transform(row, lambda v: v.cast("double")))


@query(f"WITH {E}, f AS (SELECT y, x, q::DOUBLE AS v FROM e), {_lift_sql('f', 'd', 'y', 'x', 'v', INV97, SCALE97)} SELECT y, x::INT AS x, round(v, 6) AS v FROM d")
def iwt97_row(spark, sf_dir):
    rows = views.lines(spark, sf_dir).withColumn("q", F.transform("q", lambda v: v.cast("double")))
    return _row_samples(rows, lifting.inverse97(F.col("q"))).withColumn("v", F.round("v", 6))


@query(
    f"""WITH {E}, g AS (SELECT y // 64 AS tile, y % 64 AS j, x, q::DOUBLE AS v FROM e), {_lift_sql("g", "a", "tile, x", "j", "v", INV97, SCALE97)}, {_lift_sql("a", "d", "tile, j", "x", "v", INV97, SCALE97)}
SELECT tile * 64 + j AS y, x::INT AS x, round(v, 6) AS v FROM d"""
)
def iwt97_2d(spark, sf_dir):
    planes = views.tile_planes(spark, sf_dir).withColumn("plane", _doubles("plane")).withColumn("plane", lifting.inverse_plane(F.col("plane"), lifting.inverse97))
    return views.samples(planes).withColumn("v", F.round("v", 6))


# Dequantisation.


@query(f"WITH {P} SELECT k, (CASE WHEN v >= 0 THEN (v & 2147483647) >> (31 - planes) ELSE -((v & 2147483647) >> (31 - planes)) END)::INT AS c FROM p")
def dequant_lossless(spark, sf_dir):
    return views.blocks(spark, sf_dir).select("k", quant.lossless(F.col("v"), quant.lossless_shift(F.col("planes"))).cast("int").alias("c"))


_FACTOR = "((1 + mant / 2048.0::DOUBLE) / pow(2::DOUBLE, expn)) * pow(2::DOUBLE, 8 + bit_count(orient)) / pow(2::DOUBLE, 31 - planes)"


@query(f"WITH {P} SELECT k, round({_FACTOR}, 12) AS factor FROM p")
def dequant_factor(spark, sf_dir):
    return views.blocks(spark, sf_dir).select("k", F.round(_factor(), 12).alias("factor"))


def _factor():
    return quant.lossy_factor(quant.step_size(F.col("expn"), F.col("mant")), F.lit(8), F.col("orient"), F.col("planes"))


@query(f"WITH {P} SELECT k, round((CASE WHEN v >= 0 THEN (v & 2147483647)::DOUBLE ELSE -((v & 2147483647)::DOUBLE) END) * ({_FACTOR}), 6) AS c FROM p")
def dequant_lossy(spark, sf_dir):
    return views.blocks(spark, sf_dir).select("k", F.round(quant.lossy(F.col("v"), _factor()), 6).alias("c"))


@query(f"WITH {I}, {T}, {C}, {B} SELECT orient, bit_count(orient)::INT AS gain, count(*) AS n FROM b GROUP BY ALL")
def subband_gain(spark, sf_dir):
    return geometry.subbands(_components(spark, sf_dir)).groupBy("orient").agg(F.count(F.lit(1)).alias("n")).select("orient", quant.subband_gain(F.col("orient")).cast("int").alias("gain"), "n")


@query(f"WITH {P}, s AS (SELECT *, unnest(range(w * h)) AS i FROM p) SELECT k, 32 * (k % 16) + i % w AS x, 64 * (k // 16) + i // w AS y, ((k + i) % 256)::INT AS v FROM s")
def codeblock_scatter(spark, sf_dir):
    key = F.col("k")
    rows = geometry.scatter(views.blocks(spark, sf_dir), 32 * (key % 16), 64 * F.call_function("div", key, F.lit(16)))
    return rows.select("k", "x", "y", ((key + F.col("i")) % 256).cast("int").alias("v"))


@query(f"WITH {P} SELECT k, (CASE WHEN k % 2 = 0 THEN expn + 1 ELSE expn - 3 + dec_lvl + 1 END)::INT AS mag_bits, (CASE WHEN k % 2 = 0 THEN expn + 1 ELSE expn - 3 + dec_lvl + 1 END - zero)::INT AS significant_bits FROM p")
def mag_bits(spark, sf_dir):
    planes = quant.mag_bits(F.col("k") % 2 == 0, F.col("expn"), F.col("expn"), F.lit(3), F.col("dec_lvl"), F.lit(2))
    return views.blocks(spark, sf_dir).select("k", planes.alias("mag_bits"), quant.significant_bits(planes, F.col("zero")).alias("significant_bits"))


@query(f"WITH {P} SELECT k, expn, mant, (1 + mant / 2048.0::DOUBLE) / pow(2::DOUBLE, expn) AS step FROM p")
def qcd_step_size(spark, sf_dir):
    return views.blocks(spark, sf_dir).select("k", "expn", "mant", quant.step_size(F.col("expn"), F.col("mant")).alias("step"))


# Colour.


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


def _named(names, columns):
    return [c.alias(n) for n, c in zip(names, columns, strict=True)]


@query(f"WITH {O} SELECT k, (r + 2 * g + b) >> 2 AS y, b - g AS u, r - g AS v FROM o")
def rct_forward(spark, sf_dir):
    return views.pixels(spark, sf_dir).select("k", *_named("yuv", color.reversible(*_rgb())))


@query(f"WITH {O} SELECT * FROM o")
def rct_roundtrip(spark, sf_dir):
    coded = rct_forward(spark, sf_dir)
    return coded.select("k", *_named("rgb", color.inverse_reversible(F.col("y"), F.col("u"), F.col("v"))))


_ICT = "SELECT k, 0.299::DOUBLE * r + (1 - 0.299::DOUBLE - 0.114::DOUBLE) * g + 0.114::DOUBLE * b AS y, r, g, b FROM o"


@query(f"WITH {O}, f AS ({_ICT}) SELECT k, round(y, 6) AS y, round((b - y) * (0.5::DOUBLE / (1 - 0.114::DOUBLE)), 6) AS cb, round((r - y) * (0.5::DOUBLE / (1 - 0.299::DOUBLE)), 6) AS cr FROM f")
def ict_forward(spark, sf_dir):
    return views.pixels(spark, sf_dir).select("k", *[F.round(c, 6).alias(n) for n, c in zip(("y", "cb", "cr"), color.irreversible(*_rgb()), strict=True)])


@query(
    f"""WITH {O}, s AS (SELECT k, r::DOUBLE AS y, (g - 128)::DOUBLE AS cb, (b - 128)::DOUBLE AS cr FROM o)
SELECT k, least(greatest(floor(y + 1.402::DOUBLE * cr + 0.5::DOUBLE)::INT, 0), 255) AS r, least(greatest(floor(y - 0.344136::DOUBLE * cb - 0.714136::DOUBLE * cr + 0.5::DOUBLE)::INT, 0), 255) AS g,
  least(greatest(floor(y + 1.772::DOUBLE * cb + 0.5::DOUBLE)::INT, 0), 255) AS b FROM s"""
)
def ict_inverse(spark, sf_dir):
    y, cb, cr = F.col("r").cast("double"), (F.col("g") - 128).cast("double"), (F.col("b") - 128).cast("double")
    return views.pixels(spark, sf_dir).select("k", *[color.clamp(color.whole(c), 0, 255).alias(n) for n, c in zip("rgb", color.inverse_irreversible(y, cb, cr), strict=True)])


@query(f"WITH {O} SELECT k, r - 128 AS r, g - 128 AS g, b - 128 AS b FROM o")
def dc_shift_forward(spark, sf_dir):
    return views.pixels(spark, sf_dir).select("k", *[color.shift_down(F.col(c)).alias(c) for c in "rgb"])


@query(f"WITH {O} SELECT k, least(greatest(r - g + 128, 0), 255) AS up, least(greatest(r - g, -128), 127) AS signed FROM o")
def dc_shift_inverse(spark, sf_dir):
    v = F.col("r") - F.col("g")
    return views.pixels(spark, sf_dir).select("k", color.shift_up(v).alias("up"), color.shift_up(v, signed=True).alias("signed"))


@query(f"WITH {O} SELECT k, least(greatest(r - b, -50), 50) AS v FROM o")
def clamp(spark, sf_dir):
    return views.pixels(spark, sf_dir).select("k", color.clamp(F.col("r") - F.col("b"), -50, 50).alias("v"))


_PACK = "b::BIGINT | (g::BIGINT << 8) | (r::BIGINT << 16)"


@query(f"WITH {O}, m AS (SELECT k, greatest(r, b) AS r1, greatest(g, 90) AS g1, greatest(b, g) AS b1, least(r, b) AS r2, least(g, 90) AS g2, least(b, g) AS b2 FROM o) SELECT k, b1::BIGINT | (g1::BIGINT << 8) | (r1::BIGINT << 16) AS most, b2::BIGINT | (g2::BIGINT << 8) | (r2::BIGINT << 16) AS least FROM m")
def packed_minmax(spark, sf_dir):
    a, b = color.pack(F.col("b"), F.col("g"), F.col("r")), color.pack(F.col("g"), F.lit(90), F.col("b"))
    return views.pixels(spark, sf_dir).select("k", color.packed_extreme(a, b, True).alias("most"), color.packed_extreme(a, b, False).alias("least"))


@query(f"WITH {O} SELECT k, {_PACK} | (255::BIGINT << 24) AS pixel, least(floor(r / 256.0::DOUBLE * 300), 255)::BIGINT << 16 AS scaled FROM o")
def pack_bgra(spark, sf_dir):
    zero = F.lit(0.0)
    return views.pixels(spark, sf_dir).select("k", color.pack(F.col("b"), F.col("g"), F.col("r"), 255).alias("pixel"), color.pack_scaled(F.col("r") / 256.0, zero, zero, zero, 300.0).alias("scaled"))


@query(
    f"""WITH {E}, g AS (SELECT y // 64 AS tile, y, x, q, max(y) OVER (PARTITION BY y // 64) AS last FROM e), d AS (SELECT unnest([-1, 0, 1]) AS a),
n AS (SELECT g.y, g.x, m.q FROM g, d AS dy, d AS dx JOIN g AS m ON m.y = least(greatest(g.y + dy.a, g.tile * 64), g.last) AND m.x = least(greatest(g.x + dx.a, 0), 63))
SELECT y, x, list_sort(list(q))[5] AS v FROM n GROUP BY y, x"""
)
def median3x3(spark, sf_dir):
    return views.samples(views.tile_planes(spark, sf_dir).withColumn("plane", color.median3x3(F.col("plane"))))


# Tag trees, offsets, bits.


@query(f"WITH {E}, l AS (SELECT *, unnest(range(7))::INT AS level FROM e) SELECT level, y // (1 << level)::BIGINT AS ny, x::BIGINT // (1 << level)::BIGINT AS nx, min(q) AS v FROM l GROUP BY ALL")
def tagtree_min(spark, sf_dir):
    return tagtree.pyramid(_row_samples(views.lines(spark, sf_dir), "q"), [], "y", "x", "v", 6)


@query(f"WITH {E} SELECT y // 8 AS tree, (y % 8)::INT AS j, x // 8 AS i, min(abs(q) % 9)::INT AS v FROM e GROUP BY ALL")
def tagtree_roundtrip(spark, sf_dir):
    rows = _row_samples(views.lines(spark, sf_dir), "q").groupBy("y", F.floor(F.col("x") / 8).cast("int").alias("i")).agg(F.min(F.abs("v") % 9).cast("int").alias("v"))
    return trials.tag_trees(rows.select(F.floor(F.col("y") / 8).cast("long").alias("tree"), (F.col("y") % 8).cast("int").alias("j"), "i", "v"))


@query(
    f"""WITH {P} SELECT k, coalesce(sum(w * h) OVER b, 0)::BIGINT AS coefficients, coalesce(sum(w * ((h + 3) // 4 + 2)) OVER b, 0)::BIGINT AS state FROM p
WINDOW b AS (PARTITION BY tile ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def offset_prefix_sum(spark, sf_dir):
    from pyspark.sql import Window

    before = Window.partitionBy("tile").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    stripes = bits.ceil_div(F.col("h"), 4) + 2
    return views.blocks(spark, sf_dir).select("k", F.coalesce(F.sum(F.col("w") * F.col("h")).over(before), zero).cast("long").alias("coefficients"), F.coalesce(F.sum(F.col("w") * stripes).over(before), zero).cast("long").alias("state"))


@query(f"WITH {P} SELECT k, w, h, (CASE orient WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END)::INT AS kind, (planes - zero)::INT AS significant_bits, planes, w * h AS nominal FROM p")
def task_projection(spark, sf_dir):
    kind = F.when(F.col("orient") == 1, 1).when(F.col("orient") == 3, 2).otherwise(0)
    return views.blocks(spark, sf_dir).select("k", "w", "h", kind.alias("kind"), (F.col("planes") - F.col("zero")).alias("significant_bits"), "planes", (F.col("w") * F.col("h")).alias("nominal"))


@query(f"WITH {P} SELECT k, h, ((h + 3) // 4)::BIGINT AS stripes FROM p")
def stripe_count(spark, sf_dir):
    return views.blocks(spark, sf_dir).select("k", "h", bits.ceil_div(F.col("h"), 4).alias("stripes"))


_HEX = "h AS (SELECT page_id, hex(encode(html)) AS x FROM pages)"


@query(
    f"""WITH {_HEX}, b AS (SELECT page_id, i, (16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::INT AS b FROM (SELECT page_id, x, unnest(range(length(x) // 2)) AS i FROM h))
SELECT page_id, b, count(*) AS n, sum(i)::BIGINT AS places FROM b GROUP BY ALL"""
)
def bytes_explode(spark, sf_dir):
    rows = bits.explode_bytes(views.page_bytes(spark, sf_dir), ["page_id"], "data")
    return rows.groupBy("page_id", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("places"))


@query(
    f"""WITH {_HEX}, w AS (SELECT page_id, ('0x' || x[8 * i + 1 : 8 * i + 8])::BIGINT AS v FROM (SELECT page_id, x, unnest(range(length(x) // 8)) AS i FROM h))
SELECT page_id, count(*) AS n, sum(v)::BIGINT AS total, max(v) AS most FROM w GROUP BY ALL"""
)
def be_uint32(spark, sf_dir):
    rows = views.page_bytes(spark, sf_dir).filter("octet_length(data) >= 4").select("page_id", "data", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("data") / 4).cast("int") - 1)).alias("i"))
    word = bits.big_endian(F.col("data"), F.col("i") * 4, 4)
    return rows.select("page_id", word.alias("v")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("v").alias("most"))


@query(f"WITH {P} SELECT k, lpad(bin(k % 255), 8, '0') || '11111111' || lpad(bin(k % 97), 7, '0') || '11111111' || '1111111' || lpad(bin(k % 131), 8, '0') AS bits FROM p")
def bit_unstuff(spark, sf_dir):
    key = F.col("k")
    data = F.concat(bits.big_endian_bytes(key % 255, 1), F.unhex(F.lit("FF")), bits.big_endian_bytes(key % 97, 1), F.unhex(F.lit("FF7F")), bits.big_endian_bytes(key % 131, 1))
    return views.blocks(spark, sf_dir).select("k", bits.unstuffed_bits(data).alias("bits"))


@query(f"WITH {P} SELECT k, (length(bin(k)) - 1)::INT AS log2 FROM p WHERE k > 0")
def floor_log2(spark, sf_dir):
    return views.blocks(spark, sf_dir).filter("k > 0").select("k", bits.floor_log2(F.col("k")).alias("log2"))


@query(f"WITH {P} SELECT k, (k % 9)::INT AS ones FROM p")
def comma_code(spark, sf_dir):
    code = F.concat(F.repeat(F.lit("1"), (F.col("k") % 9).cast("int")), F.lit("0"), F.bin("k"))
    return views.blocks(spark, sf_dir).select("k", bits.comma_code(code).cast("int").alias("ones"))


@query(
    f"""WITH {P}, n AS (SELECT k, 1 + k % 164 AS n FROM p)
SELECT k, n::INT AS passes, CASE WHEN n = 1 THEN '0' WHEN n = 2 THEN '10' WHEN n <= 5 THEN '11' || lpad(bin(n - 3), 2, '0') WHEN n <= 36 THEN '1111' || lpad(bin(n - 6), 5, '0') ELSE '111111111' || lpad(bin(n - 37), 7, '0') END AS code FROM n"""
)
def pass_vlc(spark, sf_dir):
    rows = views.blocks(spark, sf_dir).select("k", bits.pass_code(1 + F.col("k") % 164).alias("code"))
    return rows.select("k", bits.pass_count(F.concat("code", F.lit("1010101"))).alias("passes"), "code")


@query("SELECT p_partkey AS k, rtrim('  ' || p_name || ' ') AS r, ltrim('  ' || p_name || ' ') AS l, instr(p_name, ' ')::INT AS place, try_cast(p_brand AS INT) AS number FROM part")
def ini_helpers(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.rtrim(padded).alias("r"), F.ltrim(padded).alias("l"), F.instr("p_name", " ").alias("place"), F.expr("try_cast(p_brand AS int)").alias("number"))


# Files.


@query(
    f"""WITH {E}, t AS (SELECT DISTINCT y // 64 AS image_id FROM e), b AS (SELECT unnest(['jP  ', 'ftyp', 'jp2h', 'ihdr', 'colr', 'jp2c']) AS type, unnest([0, 0, 0, 1, 1, 0])::INT AS depth, unnest(range(6))::INT AS seq)
SELECT image_id, seq, depth, type FROM t, b"""
)
def box_parse(spark, sf_dir):
    return boxes.boxes(views.files(spark, sf_dir), "image_id").filter("error IS NULL").select("image_id", "seq", "depth", "type")


@query(f"WITH {E} SELECT y // 64 AS image_id, count(DISTINCT y)::BIGINT AS height, 64::BIGINT AS width, 1 AS components, 8 AS bits, false AS signed FROM e GROUP BY ALL")
def image_header(spark, sf_dir):
    return boxes.image_headers(boxes.boxes(views.files(spark, sf_dir), "image_id"), "image_id").select("image_id", "height", "width", "components", "bits", "signed")


@query(f"WITH {E}, t AS (SELECT DISTINCT y // 64 AS image_id FROM e), s AS (SELECT unnest(['SOC', 'SIZ', 'COD', 'QCD']) AS name, unnest([0, 2, 45, 59])::BIGINT AS place) SELECT image_id, name, place FROM t, s")
def codestream_segments(spark, sf_dir):
    return trials.segments(views.files(spark, sf_dir))


@query(f"WITH {E}, t AS (SELECT y // 64 AS image_id, count(DISTINCT y) AS h FROM e GROUP BY ALL) SELECT image_id, 0 AS tile_no, 64 AS width, h::INT AS height, 2 AS levels, true AS reversible, 8 AS bits, 7::BIGINT AS bands, 9 AS least, 11 AS most FROM t")
def codestream_parse(spark, sf_dir):
    rows = decode.parse(views.files(spark, sf_dir)).filter("error IS NULL")
    band = F.when(F.col("bytes").isNotNull(), F.col("res_no") * 4 + F.col("orient"))
    return rows.groupBy("image_id", "tile_no", "width", "height", "levels", "reversible", "bits").agg(F.count_distinct(band).alias("bands"), F.min("mag_bits").alias("least"), F.max("mag_bits").alias("most"))


@query("SELECT n_nationkey::INT AS k, '00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF' AS bytes FROM nation")
def mq_published(spark, sf_dir):
    return trials.published(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k")))


@query("SELECT n_nationkey::INT AS k, [1, 5, 1, 0] AS samples FROM nation")
def codeblock_published(spark, sf_dir):
    return trials.published_block(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k")))


@query("SELECT p_partkey AS k, hex(encode(p_name)) AS bytes FROM part")
def mq_decode(spark, sf_dir):
    return trials.arithmetic(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.encode("p_name", "utf-8").alias("data")))


@query(f"WITH {E} SELECT y, x, q AS v FROM e")
def codeblock_decode(spark, sf_dir):
    return _row_samples(trials.code_blocks(views.lines(spark, sf_dir)), "q")


@query(f"WITH {E} SELECT y // 64 AS image_id, 0 AS comp_no, (y % 64)::INT AS y, x, least(greatest(q + 128, 0), 255) AS v FROM e")
def decode_image(spark, sf_dir):
    return decode.pixels(decode.decode_images(views.files(spark, sf_dir)))


@query(
    f"""WITH {E}, p AS (SELECT y // 64 AS image_id, (y % 64)::INT AS y, x, least(greatest(q + 128, 0), 255) AS a FROM e), c AS (SELECT unnest(range(3))::INT AS comp_no)
SELECT image_id, comp_no, y, x, (CASE comp_no WHEN 0 THEN a WHEN 1 THEN 255 - a ELSE (4 * x + y) % 256 END)::INT AS v FROM p, c"""
)
def decode_lossy(spark, sf_dir):
    return decode.pixels(decode.decode_images(views.lossy_files(spark, sf_dir)))


@query(
    f"""WITH {E}, p AS (SELECT y // 64 AS image_id, (y % 64)::INT AS y, x, printf('%02X', least(greatest(q + 128, 0), 255)) AS v FROM e)
SELECT image_id, y, (54 + 4 * 64 * count(*) OVER (PARTITION BY image_id))::BIGINT AS size, string_agg(v || v || v || 'FF', '' ORDER BY x) AS line FROM p GROUP BY image_id, y"""
)
def bmp_sink(spark, sf_dir):
    files = sinks.bmp_images(decode.decode_images(views.files(spark, sf_dir))).select("image_id", "content", F.octet_length("content").cast("long").alias("size"))
    height = F.floor((F.col("size") - 54) / 256).cast("int")
    lines = files.select("*", height.alias("height"), F.explode(F.sequence(F.lit(0), height - 1)).alias("y"))
    return lines.select("image_id", "y", "size", F.hex(F.substring("content", 55 + 256 * (F.col("height") - 1 - F.col("y")), F.lit(256))).alias("line"))


@query("SELECT page_id || '.html' AS name, strlen(html)::BIGINT AS size, sha256(html) AS sha FROM pages")
def file_roundtrip(spark, sf_dir):
    """Bytes to files and back through the file source; the files stay in the shared folder."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat("page_id", F.lit(".html")).alias("name"), F.encode("html", "utf-8").alias("content"))
    folder = sinks.shared_folder(spark, "files")
    sinks.write_files(pages, folder).count()
    back = decode.read_files(spark, folder)
    return back.select(F.substring_index("image_id", "/", -1).alias("name"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha"))


@query(
    f"""WITH {P} SELECT k, (CASE WHEN size > 10 THEN size - 10 END)::INT AS tile_w, (CASE WHEN k % 2 = 0 THEN size END)::INT AS tile_h, (2 + size % 9)::INT AS cblk_exp_w,
  (CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END)::INT AS wavelet_type, k / 8.0::DOUBLE AS bp, 10000 AS mct_klt_iterations FROM p"""
)
def ini_options(spark, sf_dir):
    key, size = F.col("k"), F.col("size")
    lines = [
        F.concat(F.lit("tile_w = "), size - 10, F.lit(" ; comment")),
        F.when(key % 2 == 0, F.concat(F.lit("tile_h: "), size)),
        F.lit("[section]\n# nothing\nunknown = 5\ncblk_exp_w=1"),
        F.concat(F.lit("cblk_exp_w="), 2 + size % 9),
        F.when(key % 3 == 0, F.lit("wavelet_type = 0")),
        F.concat(F.lit("bp = "), key / 8.0),
    ]
    return trials.run_options(views.blocks(spark, sf_dir).select("k", F.concat_ws("\n", *lines).alias("text")))


@query("SELECT 100000::BIGINT AS n, true AS within, true AS centred, true AS spread, true AS constant")
def random_floats(spark, sf_dir):
    even = synthetic.random_floats(spark, 100_000, -2.0, 3.0).agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("v") >= -2) & (F.col("v") < 3)).alias("within"), (F.abs(F.avg("v") - 0.5) < 0.05).alias("centred"), (F.count_distinct("v") > 99_000).alias("spread"))
    same = synthetic.random_floats(spark, 1000, 7.0, 7.0).agg(F.bool_and(F.col("v") == 7.0).alias("constant"))
    return even.crossJoin(same)  # of one row each


@query(
    f"""WITH {P}, v AS (SELECT k, (k % 3)::INT AS style, (k % 8)::INT AS guard, list_transform(range(4), lambda b: (8 + (k + b) % 12)::INT) AS e, list_transform(range(4), lambda b: ((37 * k + b) % 2048)::INT) AS m FROM p)
SELECT k, style, guard, CASE style WHEN 1 THEN list_transform(e, lambda x: e[1]) ELSE e END AS expn, CASE style WHEN 0 THEN [0, 0, 0, 0] WHEN 1 THEN list_transform(m, lambda x: m[1]) ELSE m END AS mant FROM v"""
)
def qcd_styles(spark, sf_dir):
    return trials.quantisations(views.blocks(spark, sf_dir))


_LIST = "'[' || array_to_string({}, ', ') || ']'"


@query(
    f"""WITH k AS (SELECT n_nationkey AS k FROM nation), c AS (SELECT k, {_LIST.format("[k % 8, k % 8 + 1]")} AS inputs, {_LIST.format("[k % 8]")} AS outputs FROM k), s AS (
SELECT k, 'ADS' AS marker, {_LIST.format("list_transform(range(1 + k % 5), lambda i: (k + i) % 4)")} || ' ' || {_LIST.format("list_transform(range(k % 3), lambda i: i % 4)")} AS says FROM k
UNION ALL SELECT k, 'ATK', (k % 4) || ' ' || (k % 2) || ' ' || (k % 7) || ' ' || printf('00%02x', k) || ' ' || (1 + k % 3) || ' ' || (1 + k % 3) FROM k
UNION ALL SELECT k, 'MCC', (k % 4) || ' ' || inputs || ' ' || outputs FROM c
UNION ALL SELECT k, 'MIC', (k % 5) || ' ' || (k % 3) || ' ' || inputs FROM c)
SELECT k::INT AS k, marker, (k % 16)::INT AS index, says FROM s"""
)
def part2_segments(spark, sf_dir):
    return trials.transforms(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k")))


@query(
    f"""WITH {E}, b AS (SELECT y // 16 AS top, x // 16 AS side, count(*) AS n, -sum(CASE WHEN q = 0 THEN 0 ELSE (pow(4, length(bin(abs(q)))) - 1) / 3 END) AS lowered FROM e GROUP BY ALL)
SELECT top, side::INT AS side, lowered, round(lowered * (CASE side WHEN 0 THEN 1 WHEN 3 THEN 0.5 ELSE 1 END) * (CASE top % 4 WHEN 0 THEN CASE side WHEN 0 THEN 1 ELSE 0.1 END WHEN 1 THEN CASE side WHEN 0 THEN 1 ELSE 0.2 END
  WHEN 2 THEN CASE side WHEN 0 THEN 1 ELSE 0.4 END ELSE CASE side WHEN 0 THEN 1 ELSE 0.8 END END) * 0.25 / n, 6) AS weighted FROM b"""
)
def block_distortion(spark, sf_dir):
    samples = _row_samples(views.lines(spark, sf_dir), "q")
    blocks = samples.groupBy(F.floor(F.col("y") / 16).cast("long").alias("top"), F.floor(F.col("x") / 16).cast("int").alias("side"))
    blocks = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(quant.coded_distortion(F.col("v"))).alias("lowered"))
    weight = quant.distortion_weight(F.lit(True), F.col("top") % 4 + 1, F.col("side"), F.lit(0.5), F.col("n"), F.lit(1))
    return blocks.select("top", "side", "lowered", F.round(F.col("lowered") * weight, 6).alias("weighted"))


@query("SELECT 640 * 480 AS n, 640 * 480 AS valid, 480 AS lines FROM (SELECT 1)")
def random_source(spark, sf_dir):
    rows = synthetic.random_pixels(spark, 640, 480)
    return rows.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if((F.col("pixel") >= 0) & (F.col("pixel") < 1 << 24)).cast("int").alias("valid"), F.count_distinct("y").cast("int").alias("lines"))


@query("SELECT n_nationkey AS k, (n_nationkey % 16)::INT AS index, (n_nationkey % 4)::INT AS type, 1 AS element_type, (1 + n_nationkey % 5)::INT AS elements FROM nation")
def part2_parse(spark, sf_dir):
    return trials.part2(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inverse 5/3 level along each line of the raster, shifted up, clamped and summarised per line."""
    done = views.lines(spark, sf_dir).select("y", F.transform(lifting.inverse53(F.col("q")), lambda v: color.shift_up(v)).alias("v"))
    return done.select("y", F.array_min("v").alias("low"), F.array_max("v").alias("high"), F.aggregate("v", F.lit(0), lambda a, x: a + x).alias("total"))
