"""Products of large matrices in dense tiles.

A matrix of labels × labels is cut into square tiles, each one row
``(rb, cb, tile binary)`` with the tile's doubles in row order; empty tiles are absent. A
product replicates the tiles of both sides along the grid, so that a group holds at
most ``CHUNK`` pairs along the inner index, multiplies them in numpy, and adds up the
groups of one output tile, ``CHUNK`` at a time. No group grows with the matrix: it holds
up to ``2 · CHUNK`` tiles of ``8 · TILE²`` bytes. A product moves ``2 · grid³`` tiles,
where a join of single cells would form ``labels³`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import DEFAULT_BROADCAST_ROWS

PRODUCER = ("producer_region", "producer_sector")
CONSUMER = ("consumer_region", "consumer_sector")
LABEL = ("region", "sector")
TILE = 512
CHUNK = 8
TILES = "rb int, cb int, tile binary"


class Grid(NamedTuple):
    """Numbers of the labels, and how they are cut into tiles."""

    index: DataFrame  # (region, sector, i), i from 0
    labels: int
    tile: int

    @property
    def blocks(self) -> int:
        return max(1, math.ceil(self.labels / self.tile))

    def numbers(self, region: str, sector: str, name: str) -> DataFrame:
        """The index under the names of one side of a matrix; broadcast up to the row limit."""
        own = self.index.select(F.col("region").alias(region), F.col("sector").alias(sector), F.col("i").alias(name))
        return F.broadcast(own) if self.labels <= DEFAULT_BROADCAST_ROWS else own


def labels_of(*matrices: DataFrame) -> DataFrame:
    """Every label on either side of the matrices."""
    sides = [m.select(F.col(r).alias("region"), F.col(s).alias("sector")) for m in matrices for r, s in (PRODUCER, CONSUMER)]
    out = sides[0]
    for side in sides[1:]:
        out = out.union(side)
    return out.distinct()


def grid_of(labels: DataFrame, tile: int = TILE) -> Grid:
    """The labels in order, numbered by one window over the label dimension. ``labels``
    should be a table, as the numbering is read more than once."""
    index = labels.select(*LABEL).distinct().withColumn("i", F.row_number().over(Window.orderBy(*LABEL)) - 1)
    n = index.count()
    return Grid(index, n, max(1, min(tile, n)))


def _array(raw: bytes, t: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(t, t)


def to_tiles(matrix: DataFrame, grid: Grid) -> DataFrame:
    """Tiles of a long matrix; cells listed twice are added. A group holds the cells of
    one tile."""
    t = grid.tile
    cells = (matrix.join(grid.numbers(*PRODUCER, "i"), list(PRODUCER)).join(grid.numbers(*CONSUMER, "j"), list(CONSUMER))
             .select(F.floor(F.col("i") / t).cast("int").alias("rb"), F.floor(F.col("j") / t).cast("int").alias("cb"),
                     (F.col("i") % t).cast("int").alias("r"), (F.col("j") % t).cast("int").alias("c"),
                     F.col("value").cast("double").alias("value")))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tile = np.bincount(rows["r"].to_numpy(np.int64) * t + rows["c"].to_numpy(np.int64), weights=rows["value"].to_numpy(), minlength=t * t)
        return pd.DataFrame({"rb": [key[0]], "cb": [key[1]], "tile": [tile.tobytes()]})

    summed = cells.groupBy("rb", "cb", "r", "c").agg(F.sum("value").alias("value"))  # at most a tile of rows per group
    return summed.groupBy("rb", "cb").applyInPandas(build, TILES)


def to_cells(tiles: DataFrame, grid: Grid) -> DataFrame:
    """The non-zero cells of a tiled matrix, long."""
    t = grid.tile

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, cb, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                tile = _array(raw, t)
                r, c = np.nonzero(tile)
                yield pa.RecordBatch.from_arrays([pa.array(rb * t + r, pa.int64()), pa.array(cb * t + c, pa.int64()), pa.array(tile[r, c])],
                                                 names=["i", "j", "value"])

    return (tiles.select("rb", "cb", "tile").mapInArrow(cells, "i long, j long, value double")
            .join(grid.numbers(*PRODUCER, "i"), "i").join(grid.numbers(*CONSUMER, "j"), "j")
            .select(*PRODUCER, *CONSUMER, "value"))


def pairs(left: DataFrame, right: DataFrame, grid: Grid) -> DataFrame:
    """Both sides replicated along the grid: (rb, cb, kb, side, tile)."""
    along = F.explode(F.sequence(F.lit(0), F.lit(grid.blocks - 1)))
    a = left.select("rb", along.alias("x"), "cb", "tile").select("rb", F.col("x").alias("cb"), F.col("cb").alias("kb"), F.lit(0).alias("side"), "tile")
    b = right.select(along.alias("x"), "cb", "rb", "tile").select(F.col("x").alias("rb"), "cb", F.col("rb").alias("kb"), F.lit(1).alias("side"), "tile")
    return a.unionByName(b)


def multiply(left: DataFrame, right: DataFrame, grid: Grid, plus: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """``left · right``, or ``plus + left · right``, of tiled matrices."""
    t = grid.tile
    sides = pairs(left, right, grid)
    if plus is not None:
        sides = sides.unionByName(plus.select("rb", "cb", F.lit(0).alias("kb"), F.lit(2).alias("side"), "tile"))

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, one = None, {}
        for kb, side, raw in zip(rows["kb"], rows["side"], rows["tile"]):
            if side == 2:
                out = _array(raw, t) if out is None else out + _array(raw, t)
            else:
                one.setdefault(kb, {})[side] = raw
        for both in one.values():
            if len(both) == 2:
                more = _array(both[0], t) @ _array(both[1], t)
                out = more if out is None else out + more
        return pd.DataFrame({"rb": [key[0]], "cb": [key[1]], "part": [key[2]], "tile": [out.tobytes()]} if out is not None else
                            {"rb": [], "cb": [], "part": [], "tile": []})

    parts = math.ceil(grid.blocks / chunk)
    done = (sides.withColumn("part", F.floor(F.col("kb") / chunk).cast("int"))
            .groupBy("rb", "cb", "part").applyInPandas(product, "rb int, cb int, part int, tile binary"))

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = sum(_array(raw, t) for raw in rows["tile"])
        return pd.DataFrame({"rb": [key[0]], "cb": [key[1]], "part": [key[2]], "tile": [out.tobytes()]})

    while parts > 1:  # the sum over the inner index, a bounded number of tiles at a time
        done = (done.withColumn("part", F.floor(F.col("part") / chunk).cast("int"))
                .groupBy("rb", "cb", "part").applyInPandas(total, "rb int, cb int, part int, tile binary"))
        parts = math.ceil(parts / chunk)
    return done.select("rb", "cb", "tile")


def column_norm(tiles: DataFrame, grid: Grid) -> float:
    """The largest sum of absolute values of a column; one scalar reaches the driver."""
    t = grid.tile

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cb, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(cb * t + np.arange(t), pa.int64()), pa.array(np.abs(_array(raw, t)).sum(axis=0))],
                                                 names=["j", "s"])

    return (tiles.select("cb", "tile").mapInArrow(sums, "j long, s double").groupBy("j").agg(F.sum("s").alias("s"))
            .agg(F.max("s")).first()[0] or 0.0)
