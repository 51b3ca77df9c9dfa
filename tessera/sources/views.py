"""The test tables seen as rasters, pixels, images and code-blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lines of the raster that make a tile.
TILE = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y and q: a line of 64 integer samples per embedding, the first half its low band."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 128).cast("int")).alias("q"))


def tile_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, first line y0 and plane (array of lines): 64 lines of the raster a tile, fewer in the last one.

    A tile is the most that one row holds, so planes stay bounded as the raster grows.
    """
    rows = lines(spark, sf_dir).withColumn("tile", F.floor(F.col("y") / TILE).cast("long"))
    grouped = rows.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("y", "q"))).alias("rows"))
    return grouped.select("tile", F.col("rows")[0]["y"].alias("y0"), F.transform("rows", lambda r: r["q"]).alias("plane"))


def samples(planes: DataFrame, plane: str = "plane", value: str = "v") -> DataFrame:
    """y, x and the value of every sample of planes with their first line y0."""
    rows = planes.select("y0", F.posexplode(plane).alias("j", "line"))
    return rows.select((F.col("y0") + F.col("j")).alias("y"), F.posexplode("line").alias("x", value))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, r, g, b: a pixel of each order."""
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 256).cast("int").alias("r"), (F.floor("o_totalprice") % 256).cast("int").alias("g"), (F.col("o_orderkey") % 256).cast("int").alias("b"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h, tw, th: an image of each nation."""
    key = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(key.alias("image_id"), (640 + 37 * key).alias("w"), (480 + 23 * key).alias("h"), F.lit(256).alias("tw"), F.lit(192).alias("th"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, size, w, h, v (sign and magnitude), planes, expn, mant, orient, dec_lvl, zero, tile: a code-block of each part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    magnitude = F.pmod(key * F.lit(2654435761), F.lit(2147483648))
    return _table(spark, sf_dir, "part").select(
        key.alias("k"),
        size.alias("size"),
        (1 + size % 32).cast("int").alias("w"),
        (1 + key % 64).cast("int").alias("h"),
        F.when(key % 3 == 0, magnitude - F.lit(2147483648)).otherwise(magnitude).cast("int").alias("v"),
        (8 + size % 16).cast("int").alias("planes"),
        (size % 16).cast("int").alias("expn"),
        (key % 2048).cast("int").alias("mant"),
        (key % 4).cast("int").alias("orient"),
        (1 + key % 3).cast("int").alias("dec_lvl"),
        (size % 8).cast("int").alias("zero"),
        F.floor(key / 64).cast("long").alias("tile"),
    )


def page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and the UTF-8 bytes of its html."""
    return _table(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("data"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id and content: a JP2 file of each tile of the raster, its samples shifted up to 0..255."""
    return _encoded(spark, sf_dir, lambda image: image[None], levels=2, cblk=(5, 5))


def lossy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id and content: the same as 9/7 streams of three components, a colour transform and several tiles.

    The components are the samples, 255 less the samples, and a ramp.
    """
    import numpy as np

    def three(image):
        rows, columns = np.indices(image.shape)
        return np.stack([image, 255 - image, (4 * columns + rows) % 256])

    return _encoded(spark, sf_dir, three, levels=2, cblk=(4, 4), tile=(48, 40), mct=True, reversible=False)


def _encoded(spark: SparkSession, sf_dir: str, components, **how) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    from tessera.sources import synthetic

    def run(batches):
        for batch in batches:
            for tile, plane in zip(batch.column("tile").to_pylist(), batch.column("plane").to_pylist(), strict=True):
                image = components(np.clip(np.array(plane) + 128, 0, 255))
                stream = synthetic.encode(image, **how)
                yield pa.RecordBatch.from_pydict({"image_id": pa.array([tile], pa.int64()), "content": pa.array([synthetic.jp2(stream, image.shape[2], image.shape[1], len(image))], pa.binary())})

    return tile_planes(spark, sf_dir).select("tile", "plane").mapInArrow(run, "image_id long, content binary")
