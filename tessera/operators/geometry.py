"""Geometry of an image: tiles, tile-components, resolution levels, subbands and code-blocks.

Each function turns rows of the level above into rows of its own with `explode(sequence(...))`, so a
whole catalogue of images is laid out without a shuffle; only blocks that are laid out sample by sample
are dealt out first. Coordinates are exact integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import ceil_div

#: Subband orientations; bit 0 is high along x, bit 1 high along y.
LL, HL, LH, HH = 0, 1, 2, 3

#: Samples of code-blocks that one task lays out, about.
SAMPLES_A_TASK = 1 << 22


def _low(a: str | Column, shift: Column) -> Column:
    """ceil(a / 2**shift)"""
    a = F.col(a) if isinstance(a, str) else a
    return ceil_div(a, F.expr("cast(1 as bigint)") * F.pow(F.lit(2), shift).cast("long"))


def tiles(images: DataFrame) -> DataFrame:
    """Tiles of images (image_id, w, h, tw, th): number, column p, row q and bounds, cut at the image's edge.

    A null or non-positive tile size means one tile.
    """
    tw = F.when(F.col("tw") > 0, F.col("tw")).otherwise(F.col("w")).cast("long")
    th = F.when(F.col("th") > 0, F.col("th")).otherwise(F.col("h")).cast("long")
    grid = images.filter("w > 0 AND h > 0").withColumns({"_tw": tw, "_th": th}).withColumns({"_nx": ceil_div(F.col("w"), F.col("_tw")), "_ny": ceil_div(F.col("h"), F.col("_th"))})
    grid = grid.withColumn("tile_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nx") * F.col("_ny") - 1)))
    grid = grid.withColumns({"p": F.col("tile_no") % F.col("_nx"), "q": F.floor(F.col("tile_no") / F.col("_nx"))})
    return grid.select(
        "image_id",
        "tile_no",
        "p",
        "q",
        (F.col("p") * F.col("_tw")).alias("tlx"),
        (F.col("q") * F.col("_th")).alias("tly"),
        F.least((F.col("p") + 1) * F.col("_tw"), F.col("w").cast("long")).alias("brx"),
        F.least((F.col("q") + 1) * F.col("_th"), F.col("h").cast("long")).alias("bry"),
    )


def tile_components(tile_rows: DataFrame, components: int = 3, levels: int = 2, xcb: int = 6, ycb: int = 6) -> DataFrame:
    """A row per tile and component, with the number of levels and the code-block size 2**xcb by 2**ycb."""
    return tile_rows.withColumn("comp_no", F.explode(F.sequence(F.lit(0), F.lit(components - 1)))).withColumns({"num_dlvls": F.lit(levels), "cblk_w": F.lit(1 << xcb), "cblk_h": F.lit(1 << ycb)})


def resolution_levels(components: DataFrame) -> DataFrame:
    """A row per resolution level, res_no 0 the smallest; one subband there, three in each other."""
    rows = components.withColumn("res_no", F.explode(F.sequence(F.lit(0), F.col("num_dlvls"))))
    shift = F.col("num_dlvls") - F.col("res_no")
    rows = rows.withColumns({"_tlx": _low("tlx", shift), "_tly": _low("tly", shift), "_brx": _low("brx", shift), "_bry": _low("bry", shift)})
    rows = rows.drop("tlx", "tly", "brx", "bry").withColumnsRenamed({f"_{c}": c for c in ("tlx", "tly", "brx", "bry")})
    level = F.when(F.col("res_no") == 0, F.col("num_dlvls")).otherwise(F.col("num_dlvls") - F.col("res_no") + 1)
    return rows.withColumns({"dec_lvl_no": level, "num_subbands": F.when(F.col("res_no") == 0, 1).otherwise(3), "precinct_exp": F.lit(15)})


def subbands(components: DataFrame) -> DataFrame:
    """A row per subband: its own bounds, and its place (px, py) in the plane's quadrant order.

    Bounds are ceil((t - 2**(l-1) * bit) / 2**l) for level l; with no level there is only LL, unshifted.
    """
    rows = components.withColumn("res_no", F.explode(F.sequence(F.lit(0), F.col("num_dlvls"))))
    rows = rows.withColumn("orient", F.explode(F.when(F.col("res_no") == 0, F.array(F.lit(LL))).otherwise(F.array(F.lit(HL), F.lit(LH), F.lit(HH)))))
    level = F.when(F.col("res_no") == 0, F.col("num_dlvls")).otherwise(F.col("num_dlvls") - F.col("res_no") + 1)
    rows = rows.withColumn("dec_lvl_no", level)
    half = F.when(F.col("dec_lvl_no") > 0, F.pow(F.lit(2), F.col("dec_lvl_no") - 1)).otherwise(F.lit(0)).cast("long")
    x_high, y_high = F.col("orient").bitwiseAND(1), F.shiftright("orient", 1)
    bounds = {f"_{c}": _low(F.col(c) - half * (x_high if c[-1] == "x" else y_high), F.col("dec_lvl_no")) for c in ("tlx", "tly", "brx", "bry")}
    rows = rows.withColumns(bounds)
    low_w = _low("brx", F.col("dec_lvl_no")) - _low("tlx", F.col("dec_lvl_no"))
    low_h = _low("bry", F.col("dec_lvl_no")) - _low("tly", F.col("dec_lvl_no"))
    rows = rows.withColumns({"px": x_high * low_w, "py": y_high * low_h})
    rows = rows.drop("tlx", "tly", "brx", "bry").withColumnsRenamed({f"_{c}": c for c in ("tlx", "tly", "brx", "bry")})
    # Code-blocks lie on a grid that is anchored at 0.
    for axis, size in (("x", "cblk_w"), ("y", "cblk_h")):
        first, last = F.floor(F.col(f"tl{axis}") / F.col(size)), ceil_div(F.col(f"br{axis}"), F.col(size))
        rows = rows.withColumns({f"cb0{axis}": first, f"num_{axis}cblks": F.when(F.col(f"br{axis}") > F.col(f"tl{axis}"), last - first).otherwise(0).cast("long")})
    return rows


def codeblocks(bands: DataFrame) -> DataFrame:
    """A row per code-block of subbands that have any: raster number, place and bounds cut at the subband's."""
    count = F.col("num_xcblks") * F.col("num_ycblks")
    rows = bands.filter(count > 0).withColumn("cblk_no", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    rows = rows.withColumns({"no_x": F.col("cblk_no") % F.col("num_xcblks"), "no_y": F.floor(F.col("cblk_no") / F.col("num_xcblks"))})
    for axis, size in (("x", "cblk_w"), ("y", "cblk_h")):
        start = (F.col(f"cb0{axis}") + F.col(f"no_{axis}")) * F.col(size)
        rows = rows.withColumns({f"c_tl{axis}": F.greatest(start, F.col(f"tl{axis}")), f"c_br{axis}": F.least(start + F.col(size), F.col(f"br{axis}"))})
    return rows


def scatter(blocks: DataFrame, x0: Column, y0: Column) -> DataFrame:
    """k, raster number i and place (x, y) of every sample of code-blocks (k, w, h) that begin at (x0, y0), columns over k, w and h.

    A block is a few bytes and up to thousands of samples, so few files, even one, hold work for many tasks:
    blocks are dealt out one by one, whatever their files and keys, to as many tasks as all samples, summed
    up in a pass of its own, ask for. A block without samples gives no row.
    """
    count = F.col("w").cast("long") * F.col("h")
    held = blocks.select("k", "w", "h").filter(count > 0)
    samples = held.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    tasks = max(held.sparkSession.sparkContext.defaultParallelism, -(-samples // SAMPLES_A_TASK))
    places = F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    rows = held.repartition(tasks).select("k", "w", x0.alias("_x0"), y0.alias("_y0"), places.alias("i"))
    return rows.select("k", "i", (F.col("_x0") + F.col("i") % F.col("w")).alias("x"), (F.col("_y0") + F.call_function("div", F.col("i"), F.col("w"))).alias("y"))
