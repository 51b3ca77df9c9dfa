"""Pixels to files: 32-bit BMP images and raw bytes."""

from __future__ import annotations

import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh name below the folder that all executors share (spark.checkpoint.dir); only a local session may lack that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-files-")
    return f"{root.rstrip('/')}/tessera-{what}-{uuid.uuid4().hex}"


def bmp(image: np.ndarray) -> bytes:
    """A 32-bit BMP of packed pixels (height, width; blue in the lowest byte), bottom line first."""
    height, width = image.shape
    body = np.ascontiguousarray(image[::-1], "<u4").tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 32, 0, len(body), 2835, 2835, 0, 0) + body


def bmp_images(lines: DataFrame) -> DataFrame:
    """image_id and content of a BMP per image, from decoded lines of 8-bit images with one or three components.

    One image's lines meet in a task; images are spread over tasks.
    """

    def run(table: pa.Table) -> pa.Table:
        component, y, left = (table.column(c).to_numpy() for c in ("comp_no", "y", "x0"))
        samples = table.column("samples").combine_chunks()
        ends, flat = samples.offsets.to_numpy(), samples.values.to_numpy()
        parts = np.zeros((component.max() + 1, y.max() + 1, (left + np.diff(ends)).max()), np.uint32)
        for k in range(table.num_rows):
            line = flat[ends[k] : ends[k + 1]]
            parts[component[k], y[k], left[k] : left[k] + len(line)] = line
        red, green, blue = parts[:3] if len(parts) >= 3 else (parts[0],) * 3
        return pa.table({"image_id": table.column("image_id").slice(0, 1), "content": pa.array([bmp(blue | green << 8 | red << 16 | np.uint32(0xFF000000))], pa.binary())})

    kind = lines.schema["image_id"].dataType.simpleString()
    return lines.groupBy("image_id").applyInArrow(run, f"image_id {kind}, content binary")


def write_files(contents: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes a file for each row to a shared folder and returns (name, size); run by an action on it.

    A file is written under another name first, so a lost task leaves no half file.
    """

    def run(batches):
        fs, place = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(place, recursive=True)
        for part in batches:
            names, bodies = part.column(0).to_pylist(), part.column(1).to_pylist()
            for one, body in zip(names, bodies, strict=True):
                with fs.open_output_stream(f"{place}/_{one}") as out:
                    out.write(body or b"")
                fs.move(f"{place}/_{one}", f"{place}/{one}")
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "size": pa.array([len(b or b"") for b in bodies], pa.int64())})

    return contents.select(contents[name].cast("string"), content).mapInArrow(run, "name string, size long")
