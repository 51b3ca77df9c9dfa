"""Image decoding as a plan: files to code-blocks, code-blocks to samples, tiles to pixels.

`binaryFile` rows are parsed where they are read; the code-blocks are dealt out again, because one
image may hold most of them; each is decoded on its own; then a tile's blocks meet in one task, which
holds that tile and nothing more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import entropy, planes
from tessera.sources import boxes, codestream

_INTS = ["tile_no", "comp_no", "res_no", "dec_lvl_no", "orient", "cblk_no", "x", "y", "w", "h", "expn", "mant", "mag_bits", "significant_bits", "passes", "tlx", "tly", "tile_w", "tile_h", "width", "height", "components", "bits", "levels"]
_FLAGS = ["signed", "reversible", "use_mct"]
_TYPES = [(c, pa.int32()) for c in _INTS] + [(c, pa.bool_()) for c in _FLAGS] + [("bytes", pa.binary()), ("error", pa.string())]
SCHEMA = ", ".join([f"{c} int" for c in _INTS] + [f"{c} boolean" for c in _FLAGS] + ["bytes binary", "error string"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """image_id (the path) and content of every file below a path, by content and not by name."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("image_id"), "content")


def parse(files: DataFrame, max_res: int | None = None) -> DataFrame:
    """A row per included code-block of (image_id, content), and one without bytes per tile.

    A file that can't be parsed to its end gives one row with `error` and no other.
    `max_res` leaves out higher resolution levels before they are decoded.
    """

    def batch(name, rows, kind):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), kind), *[pa.array([r.get(c) for r in rows], t) for c, t in _TYPES]], names=["image_id", *[c for c, _ in _TYPES]])

    def run(batches):
        for part in batches:
            for name, content in zip(part.column("image_id"), part.column("content"), strict=True):
                try:  # the blocks' bytes are no more than the file's, which is held anyway
                    rows = list(codestream.codeblocks(boxes.codestream(content.as_py() or b""), max_res))
                except ValueError as e:
                    rows = [{"error": str(e)}]
                for at in range(0, len(rows), 1000):
                    yield batch(name.as_py(), rows[at : at + 1000], part.column("image_id").type)

    kind = files.schema["image_id"].dataType.simpleString()
    return files.select("image_id", "content").mapInArrow(run, f"image_id {kind}, {SCHEMA}")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """Code-blocks with `samples`: sign and magnitude, first bit-plane at bit 30, row by row; none for a tile's own row."""

    def run(batches):
        for part in batches:
            rows = part.select(["bytes", "w", "h", "orient", "significant_bits", "passes", "mag_bits"]).to_pylist()
            decoded = [np.array(entropy.decode_block(r["bytes"], r["w"], r["h"], r["orient"], r["significant_bits"], r["passes"], r["mag_bits"]), np.int32) if r["bytes"] is not None else np.zeros(0, np.int32) for r in rows]
            ends = np.cumsum([0, *map(len, decoded)])
            samples = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *decoded])))
            kept = part.drop_columns(["bytes"])
            yield pa.RecordBatch.from_arrays([*kept.columns, samples], names=[*kept.schema.names, "samples"])

    # The cost of a block is its bytes: deal them out by a hash of the whole key.
    key = ["image_id", "tile_no", "comp_no", "res_no", "orient", "cblk_no"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name != "bytes")
    return blocks.repartition(*key).mapInArrow(run, f"{fields}, samples array<int>")


def _tile(table: pa.Table, max_res: int | None) -> pa.Table:
    samples = table.column("samples").combine_chunks()
    ends, flat = samples.offsets.to_numpy(), samples.values.to_numpy().astype(np.int64)
    rows = table.drop_columns(["samples"]).to_pylist()
    r0 = rows[0]
    drop = r0["levels"] - min(r0["levels"], max_res) if max_res is not None else 0
    height, width, levels = -(-r0["tile_h"] // (1 << drop)), -(-r0["tile_w"] // (1 << drop)), r0["levels"] - drop
    out = np.zeros((r0["components"], height, width), np.int64 if r0["reversible"] else np.float64)
    for k, r in enumerate(rows):
        if ends[k] == ends[k + 1]:  # the tile's own row: what no block covers stays zero
            continue
        v = flat[ends[k] : ends[k + 1]].reshape(r["h"], r["w"])
        m = v & 0x7FFFFFFF
        if r["reversible"]:
            m = m >> (31 - r["mag_bits"])
        else:
            gain = (0, 1, 1, 2)[r["orient"]]
            step = (1 + r["mant"] / 2048) * 2.0 ** (r["bits"] + gain - r["expn"])
            m = m * (step / 2.0 ** (31 - r["mag_bits"]))
        out[r["comp_no"], r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.where(v < 0, -m, m)
    done = np.stack([planes.inverse(p, levels, r0["reversible"]) for p in out])
    pixels = planes.colours(done, r0["reversible"], r0["use_mct"], r0["bits"], r0["signed"])
    count = len(pixels) * height
    names = ["image_id", "tile_no", "comp_no", "y", "x0", "samples"]
    scale = 1 << drop
    arrays = [
        pa.array([r0["image_id"]] * count, table.schema.field("image_id").type),
        pa.array([r0["tile_no"]] * count, pa.int32()),
        pa.array(np.repeat(np.arange(len(pixels)), height), pa.int32()),
        pa.array(np.tile(np.arange(height) + -(-r0["tly"] // scale), len(pixels)), pa.int32()),
        pa.array([-(-r0["tlx"] // scale)] * count, pa.int32()),
        pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * width, pa.int32()), pa.array(pixels.reshape(-1), pa.int32())),
    ]
    return pa.table(dict(zip(names, arrays, strict=True)))


def decode_images(files: DataFrame, max_res: int | None = None) -> DataFrame:
    """A row per line of each tile and component: image_id, tile_no, comp_no, y, x0 and samples from x0 on.

    Blocks that aren't coded are zeros, in a tile without any coded block too. A file that can't be parsed
    to its end gives no lines at all (see `parse` for errors).
    """
    return decode_parsed(parse(files, max_res), max_res)


def decode_parsed(rows: DataFrame, max_res: int | None = None) -> DataFrame:
    """The lines of what `parse` has made with the same `max_res`."""
    decoded = decode_blocks(rows.filter("error IS NULL")).drop("error")

    def run(table: pa.Table) -> pa.Table:
        return _tile(table, max_res)

    kind = rows.schema["image_id"].dataType.simpleString()
    return decoded.groupBy("image_id", "tile_no").applyInArrow(run, f"image_id {kind}, tile_no int, comp_no int, y int, x0 int, samples array<int>")


def pixels(lines: DataFrame) -> DataFrame:
    """(image_id, comp_no, y, x, v) of decoded lines."""
    return lines.select("image_id", "comp_no", "y", "x0", F.posexplode("samples").alias("x", "v")).select("image_id", "comp_no", "y", (F.col("x") + F.col("x0")).alias("x"), "v")
