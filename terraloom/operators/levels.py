"""Multi-level tile keys: every box is stored at the level that fits its own size.

The tiles of level n have sides of 4**n units.  A box belongs to the smallest level whose
tiles are at least as large as the box, so it touches at most four of them, whatever the
units and however mixed the sizes are.  Two boxes that meet share a tile at the level of
the larger one; the smaller one is listed there too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["lv", "tx", "ty"]


def _own(box: Sequence[str]) -> Column:
    side = F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1]))
    return F.when(side > 0, F.ceil(F.log(side) / math.log(4) + 1e-9)).cast("int")


def levels_in_use(df: DataFrame, box: Sequence[str]) -> tuple[list[int], float]:
    """Levels of all boxes with an extent (one number for each factor of 4 in size), and the largest coordinate."""
    row = df.agg(F.collect_set(_own(box)).alias("levels"), F.max(F.greatest(*[F.abs(F.col(c)) for c in box])).alias("far")).first()
    return sorted(row["levels"]), row["far"] or 0.0


def _tiles(df: DataFrame, box: Sequence[str], own: Column, levels: Column) -> DataFrame:
    """A row per tile (lv, tx, ty) that a box touches at ``levels``; ``own`` marks its level."""
    size = F.pow(F.lit(4e0), F.col("lv"))
    at = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    listed = df.withColumn("_own", own).withColumn("lv", F.explode(levels))
    return listed.withColumn("tx", at(box[0], box[2])).withColumn("ty", at(box[1], box[3]))


def tile_pairs(a: DataFrame, abox: Sequence[str], b: DataFrame, bbox: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tiles, ready for an equi-join on ``KEY`` and :func:`met`.

    Each box is listed at its own level and at the higher levels in use on the other side.
    """
    (la, fa), (lb, fb) = levels_in_use(a, abox), levels_in_use(b, bbox)
    far = max(fa, fb)
    least = max(min([*la, *lb], default=0), math.ceil(math.log(max(far, 1e-290) * 1e-12, 4)))  # for points; tile numbers stay below 2**63

    def side(df: DataFrame, box: Sequence[str], other: list[int], name: str) -> DataFrame:
        own = F.greatest(_own(box), F.lit(least))
        above = F.filter(F.array(*[F.lit(x) for x in sorted({max(x, least) for x in other} | {least})]), lambda x: x > F.col("_own"))
        return _tiles(df, box, own, F.concat(F.array("_own"), above)).withColumnRenamed("_own", f"_own_{name}")

    return side(a, abox, lb, "a"), side(b, bbox, la, "b")


def met(abox: Sequence[str], bbox: Sequence[str]) -> Column:
    """Of the tiles two boxes share, the one in which their pair counts; the boxes must meet."""
    size = F.pow(F.lit(4e0), F.col("lv"))
    x, y = F.greatest(F.col(abox[0]), F.col(bbox[0])), F.greatest(F.col(abox[1]), F.col(bbox[1]))
    meet = (F.col(abox[0]) <= F.col(bbox[2])) & (F.col(bbox[0]) <= F.col(abox[2])) & (F.col(abox[1]) <= F.col(bbox[3])) & (F.col(bbox[1]) <= F.col(abox[3]))
    return meet & (F.col("lv") == F.greatest("_own_a", "_own_b")) & (F.floor(x / size) == F.col("tx")) & (F.floor(y / size) == F.col("ty"))
