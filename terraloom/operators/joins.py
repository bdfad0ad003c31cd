"""Keyed, dated and file-listing joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from terraloom.operators.levels import KEY, met, tile_pairs
from terraloom.scale import global_row_number, shuffled


def left_join_fill(left: DataFrame, right: DataFrame, on: Sequence[str], fill) -> DataFrame:
    return left.join(shuffled(right), list(on), "left").fillna(fill)


def join_series_with_dates(series: DataFrame, dates: DataFrame, on: str = "norec") -> DataFrame:
    """Full outer join: blocks without dates and dates without blocks are kept."""
    return series.join(shuffled(dates), on, "full")


def inner_join_suffixed(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes=("_x", "_y")) -> DataFrame:
    """Inner equi-join; columns present on both sides get suffixes."""
    clash = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left.join(shuffled(right), list(on))


def first_match_join(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each left row with the first right row of its key; unmatched left rows are dropped."""
    rest = [c for c in right.columns if c not in on]
    first = right.groupBy(*on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m"))
    return left.join(shuffled(first), list(on)).select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in rest])


def tolerance_join(
    left: DataFrame, right: DataFrame, days: int = 1, on: Sequence[str] = (), left_cols=("start", "end"), right_cols=("start", "end"),
) -> DataFrame:
    """Rows whose start/end dates differ by at most ``days`` (start to end or end to start).

    Both sides carry a day bucket as wide as the tolerance, so only neighbouring buckets
    meet; ``on`` adds equality keys such as the pixel.
    """
    ls, le = (F.datediff(c, F.lit("1970-01-01")) for c in left_cols)
    rs, re_ = (F.datediff(F.col(f"r.{c}"), F.lit("1970-01-01")) for c in right_cols)
    width = 2 * days + 1

    def bucket(day: Column) -> Column:
        return F.floor(day / width)

    def around(day: Column) -> list[Column]:
        return [bucket(day - days), bucket(day + days)]

    lefts = F.array_distinct(F.array(*around(ls), *around(le)))
    first, last = (F.datediff(c, F.lit("1970-01-01")) for c in right_cols)
    rights = F.array_distinct(F.array(bucket(first), bucket(last)))
    l2 = left.withColumn("_lb", lefts).withColumn("_b", F.explode("_lb"))
    r2 = right.select(F.struct(*right.columns).alias("r"), *on, rights.alias("_rb")).withColumn("_b", F.explode("_rb"))
    hit = l2.join(shuffled(r2) if on else r2, [*on, "_b"])
    ok = (F.abs(ls - re_) <= days) | (F.abs(le - rs) <= days)
    # a pair can meet in two buckets; it is kept in the lowest one both sides carry
    once = F.col("_b") == F.array_min(F.array_intersect("_lb", "_rb"))
    return hit.where(ok & once).select(*left.columns, "r")


def bbox_overlap_fraction(a: Sequence[str], b: Sequence[str]) -> Column:
    """Intersection of boxes a and b (x0, y0, x1, y1) over the area of b."""
    w = F.least(F.col(a[2]), F.col(b[2])) - F.greatest(F.col(a[0]), F.col(b[0]))
    h = F.least(F.col(a[3]), F.col(b[3])) - F.greatest(F.col(a[1]), F.col(b[1]))
    area = (F.col(b[2]) - F.col(b[0])) * (F.col(b[3]) - F.col(b[1]))
    return F.when((w > 0) & (h > 0), w * h / area).otherwise(0e0)


def nearest_scene(left: DataFrame, right: DataFrame, max_days: int, min_overlap: float = 0.5) -> DataFrame:
    """For each left scene the overlapping right scene nearest in date.

    Inputs: id, dt (may be null), x0, y0, x1, y1; ``right`` also ``ord`` (listing order).
    Undated right scenes, or any right scene for an undated left one, serve only when no
    dated match exists.  Only distinct footprints are matched in space; the dates of a left
    footprint and of what it is offered are then sorted together, and each date looks back
    and ahead, so neither files nor dates multiply.
    """
    box = ["x0", "y0", "x1", "y1"]
    rbox = ["rx0", "ry0", "rx1", "ry1"]
    lk = left.select("dt", *box).distinct()
    rk = right.groupBy("dt", *box).agg(F.min_by(F.struct("ord", "id"), "ord").alias("m")).select(
        F.col("dt").alias("rdt"), *[F.col(b).alias(r) for b, r in zip(box, rbox)], "m")
    here, there = tile_pairs(lk.select(*box).distinct(), box, rk.select(*rbox).distinct(), rbox)
    places = here.join(shuffled(there), KEY).where(met(box, rbox)).where(bbox_overlap_fraction(rbox, box) >= min_overlap).select(*box, *rbox)
    offered = rk.join(shuffled(places), rbox).select(*box, F.col("rdt").alias("dt"), "m", F.lit(True).alias("offered"), F.lit(None).cast("boolean").alias("asked"))
    asked = lk.select(*box, "dt", F.lit(None).cast(rk.schema["m"].dataType).alias("m"), F.lit(None).cast("boolean").alias("offered"), F.lit(True).alias("asked"))
    # a row per footprint and date, in one place per footprint
    dates = asked.unionByName(offered).repartition(*box).groupBy(*box, "dt").agg(
        F.max("asked").alias("asked"), F.min("m").alias("m"), F.min(F.when(F.col("offered") & F.col("dt").isNotNull(), F.struct("m"))).alias("pick"))
    place = W.partitionBy(*box)
    up, down = (place.orderBy(o).rowsBetween(W.unboundedPreceding, W.currentRow) for o in (F.asc("dt"), F.desc("dt")))
    scene = F.when(F.col("pick").isNotNull(), F.struct("dt", "pick.m"))
    gap = lambda c: F.abs(F.datediff(f"{c}.dt", "dt"))
    near = lambda c: F.when(gap(c) <= max_days, F.struct(gap(c).alias("days"), F.col(f"{c}.m").alias("m")))
    best = (
        dates.withColumns({
            "m_any": F.min("m").over(place), "m_undated": F.min(F.when(F.col("dt").isNull(), F.col("m"))).over(place),
            "before": F.last(scene, ignorenulls=True).over(up), "after": F.last(scene, ignorenulls=True).over(down)})
        .where("asked").withColumn("d", F.least(near("before"), near("after")))
        .select("dt", *box, F.col("d.days").alias("days"), F.coalesce("d.m", F.when(F.col("dt").isNull(), F.col("m_any")).otherwise(F.col("m_undated"))).alias("best"))
        .where("days is not null or best is not null")
    )
    return left.alias("l").join(shuffled(best.alias("b")), [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["dt", *box]], "left").select(
        "l.*", F.col("best.id").alias("match_id"), "days")


def pair_by(left: DataFrame, right: DataFrame, matcher: Callable[[Column, Column], Column], col: str) -> DataFrame:
    """Pairs accepted by a user's column rule on ``col``; equality rules become hash joins."""
    l2, r2 = left.alias("l"), right.alias("r")
    return l2.join(r2, matcher(F.col(f"l.{col}"), F.col(f"r.{col}"))).select(
        F.struct("l.*").alias("left"), F.struct("r.*").alias("right"))


def stem_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys (stem) found in both listings, with the last name of each."""
    a = left.groupBy("stem").agg(F.max("name").alias("left_name"))
    b = right.groupBy("stem").agg(F.max("name").alias("right_name"))
    return a.join(shuffled(b), "stem")


def tiered_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs by stem; if none at all, by date (last file of a date wins); else by sorted position.

    Inputs: name, stem, dt.  Returns left_name, right_name, rule.
    """
    by_stem = stem_pairs(left, right)
    if not by_stem.isEmpty():
        return by_stem.select("left_name", "right_name", F.lit("stem").alias("rule"))
    last = lambda df, out: df.where("dt is not null").groupBy("dt").agg(F.max("name").alias(out))
    by_date = last(left, "left_name").join(last(right, "right_name"), "dt")
    if not by_date.isEmpty():
        return by_date.select("left_name", "right_name", F.lit("date").alias("rule"))
    pos = lambda df, out: global_row_number(df.select(F.col("name").alias(out)), [out], "pos")
    return pos(left, "left_name").join(shuffled(pos(right, "right_name")), "pos").select(
        "left_name", "right_name", F.lit("position").alias("rule"))


def pick_band_file(listing: DataFrame, patterns: Sequence[str], key: str = "scene") -> DataFrame:
    """Per scene the first file by pattern priority, then by name."""
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        rank = F.when(F.col("name").rlike(p), i).otherwise(rank)
    hits = listing.withColumn("_rank", rank).where("_rank is not null")
    return hits.groupBy(key).agg(F.min(F.struct("_rank", "name")).alias("m")).select(
        key, F.col("m.name").alias("name"), F.col("m._rank").alias("priority"))


def add_static_layers(px: DataFrame, layers: Mapping[str, DataFrame], on: Sequence[str] = ("r", "c")) -> DataFrame:
    """Attach time-invariant layers to every image pixel; one row per pixel on the right."""
    for layer in layers.values():
        px = px.join(shuffled(layer), list(on), "left")
    return px
