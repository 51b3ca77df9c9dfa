"""Tag trees: the pyramid of minima as an aggregation, and the bit-serial coder of packet headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import BitReader, BitWriter


def pyramid(leaves: DataFrame, keys: list[str], y: str, x: str, value: str, levels: int) -> DataFrame:
    """Minimum of each node of a quad pyramid: level 0 holds the leaves, each level halves both sides.

    Every leaf row is expanded to its ancestors and summed up in one aggregation, whose partial step
    leaves a row for each node and task to shuffle.
    """
    rows = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))

    def ancestor(c: str) -> Column:
        return F.floor(F.col(c) / F.pow(F.lit(2), F.col("level"))).cast("long")

    rows = rows.select(*keys, "level", ancestor(y).alias("ny"), ancestor(x).alias("nx"), F.col(value).alias("v"))
    return rows.groupBy(*keys, "level", "ny", "nx").agg(F.min("v").alias("v"))


class TagTree:
    """Nodes by level; each knows a lower bound of its value and whether the value is known."""

    def __init__(self, width: int, height: int):
        self.sizes = [(width, height)]
        while self.sizes[-1] != (1, 1) and width and height:
            w, h = self.sizes[-1]
            self.sizes.append(((w + 1) // 2, (h + 1) // 2))
        self.low = [[0] * (w * h) for w, h in self.sizes]
        self.known = [[False] * (w * h) for w, h in self.sizes]
        self.value = [[999] * (w * h) for w, h in self.sizes]

    def set(self, x: int, y: int, value: int) -> None:
        for k, (w, _) in enumerate(self.sizes):
            at = (y >> k) * w + (x >> k)
            self.value[k][at] = min(self.value[k][at], value)

    def _path(self, x: int, y: int):
        """(level, node) from the root down to a leaf."""
        for k in reversed(range(len(self.sizes))):
            yield k, (y >> k) * self.sizes[k][0] + (x >> k)

    def decode(self, bits: BitReader, x: int, y: int, threshold: int) -> bool:
        """Whether the leaf's value is less than the threshold, reading as many bits as that takes."""
        low = 0
        for k, at in self._path(x, y):
            low = max(low, self.low[k][at])
            while low < threshold and not self.known[k][at]:
                if bits.bit():
                    self.known[k][at] = True
                else:
                    low += 1
            self.low[k][at] = low
        return self.known[0][at] and low < threshold

    def encode(self, bits: BitWriter, x: int, y: int, threshold: int) -> None:
        low = 0
        for k, at in self._path(x, y):
            low = max(low, self.low[k][at])
            while low < threshold and not self.known[k][at]:
                if self.value[k][at] > low:
                    bits.bit(0)
                    low += 1
                else:
                    bits.bit(1)
                    self.known[k][at] = True
            self.low[k][at] = low
