"""Class breaks and class assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terraloom.scale import exact_percentiles, materialize, release, running_totals


def class_breaks(df: DataFrame, col: str, n: int, method: str) -> DataFrame:
    """One row ``breaks``: rising class limits from the smallest to the largest value."""
    steps = F.sequence(F.lit(0), F.lit(n))
    if method == "quantile":
        q = exact_percentiles(df, col, {f"q{i}": i / n for i in range(n + 1)})
        return q.select(F.array(*[f"q{i}" for i in range(n + 1)]).alias("breaks"))
    if method == "jenks":
        return jenks_breaks(df, col, n)
    one = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"),
                 F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))
    lo, hi = F.col("lo"), F.col("hi")
    if method == "equal":
        b = F.transform(steps, lambda i: lo + i * (hi - lo) / n)
    elif method == "geometric":
        b = F.transform(steps, lambda i: lo * F.pow(hi / lo, i / F.lit(float(n))))
    elif method == "stddev":
        k = F.sequence(F.lit(-n), F.lit(n))
        inner = F.filter(F.transform(k, lambda i: F.col("m") + i * F.col("s")), lambda v: (v > lo) & (v < hi))
        b = F.concat(F.array(lo), inner, F.array(hi))
    elif method == "pretty":
        raw = (hi - lo) / n
        base = F.pow(F.lit(10e0), F.floor(F.log10(raw)))
        step = base * F.when(raw / base < 1.5, 1e0).when(raw / base < 3.5, 2e0).when(raw / base < 7.5, 5e0).otherwise(10e0)
        b = F.transform(F.sequence(F.floor(lo / step), F.ceil(hi / step)), lambda i: i * step)
    else:
        raise ValueError(f"unknown method {method}")
    return one.select(b.alias("breaks"))


def assign_class(df: DataFrame, col: str, breaks: DataFrame, out: str = "class_no") -> DataFrame:
    """Class 1..k by upper-inclusive limits; the breaks travel as one scalar."""
    b = breaks.select("breaks").scalar()
    cls = F.greatest(F.size(F.filter("_b", lambda v: v < F.col(col))), F.lit(1))
    # ``least`` keeps values above the last limit in the last class
    return df.withColumn("_b", b).withColumn(
        out, F.when(F.col(col).isNotNull(), F.least(cls, F.size("_b") - 1))).drop("_b")


_LAYER = "i bigint, v double, tn double, ts double, tss double, cost double, cut bigint"


def _solve(sub: tuple[int, int, int, int], ends: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
    """Best cost and cut of the ends lo..hi, whose last class starts after one of the cuts a..b."""
    lo, hi, a, b = sub
    ends, cuts = ends.sort_values("i").reset_index(drop=True), cuts.sort_values("i")
    en, es, ess = (ends[c].to_numpy() for c in ("tn", "ts", "tss"))
    cn, cs, css, before = (cuts[c].to_numpy() for c in ("tn", "ts", "tss", "cost"))
    cost, cut = np.empty(len(ends)), np.empty(len(ends), np.int64)
    todo = [(lo, hi, a, b)]
    while todo:
        low, high, first, last = (np.array(t) for t in zip(*todo))
        mid = (low + high) // 2
        size = np.minimum(last, mid - 1) - first + 1
        at = np.cumsum(size) - size
        i = np.repeat(first - a - at, size) + np.arange(size.sum())
        j = np.repeat(mid - lo, size)
        total = before[i] + (ess[j] - css[i]) - (es[j] - cs[i]) ** 2 / (en[j] - cn[i])
        best = np.minimum.reduceat(total, at)
        hit = np.flatnonzero(total == np.repeat(best, size))
        got = i[hit[np.searchsorted(hit, at)]] + a
        cost[mid - lo], cut[mid - lo] = best, got
        todo = [(p, m - 1, x, y) for p, m, x, y in zip(low.tolist(), mid.tolist(), first.tolist(), got.tolist()) if p < m] + [
            (m + 1, q, y, z) for q, m, y, z in zip(high.tolist(), mid.tolist(), got.tolist(), last.tolist()) if m < q]
    return ends[["i", "v", "tn", "ts", "tss"]].assign(cost=cost, cut=cut)


def _within(rows: DataFrame, ranges: list[tuple], task: int, first: str, last: str) -> DataFrame:
    """Rows of a layer in each of the ranges (lo, hi, a, b, ...), numbered ``sub``; an equi-join on blocks of ``task`` rows.

    There are a few ranges for every ``task`` rows.  As an Arrow table they have a known, small size (rows of a Python list
    have none), so Spark sends them to the layer, which is not placed anew.
    """
    names = ("lo", "hi", "a", "b", "mn", "ms", "mss")
    kinds = dict.fromkeys(names[:4], pa.int64()) | dict.fromkeys(names[4:], pa.float64())
    made = rows.sparkSession.createDataFrame(pa.table(
        {"sub": pa.array(range(len(ranges)), pa.int64())} | {k: pa.array([r[j] for r in ranges], kinds[k]) for j, k in enumerate(names)}))
    blocks = made.withColumn("block", F.explode(F.expr(f"sequence({first} div {task}, {last} div {task})")))
    return rows.withColumn("block", F.expr(f"i div {task}")).join(blocks, "block").where(f"i between {first} and {last}").drop("block")


def jenks_breaks(df: DataFrame, col: str, n: int, task: int = 250_000) -> DataFrame:
    """Natural breaks: the class limits with the least variance within classes, exact for any number of distinct values.

    Running sums of the distinct values in order give the deviation of any run of them.
    Classes are added one by one.  The best cut before an end never moves left as the end
    moves right, so the end in the middle of a range splits the ends and the cuts in two.
    Ranges of more than ``task`` rows are split by Spark (one aggregation per level over the
    whole layer); what is smaller is solved by halving inside one task each.  Per class the
    work is O(m log m) for m distinct values, and no task holds more than ``task`` of them.
    """
    spark = df.sparkSession
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"))
    counts = materialize(counts)
    m, mean = counts.agg(F.count("*"), F.sum(F.col("v") * F.col("n")) / F.sum("n")).first()
    if not m:
        return counts.select(F.array("v").alias("breaks"))
    x = F.col("v") - F.lit(mean)  # the sums stay small
    sums = running_totals(counts, ["v"], {"i": F.lit(1).cast("bigint"), "tn": F.col("n"), "ts": F.col("n") * x, "tss": F.col("n") * x * x})
    cost = F.col("tss") - F.col("ts") * F.col("ts") / F.col("tn")
    layer = materialize(sums.select("i", "v", "tn", "ts", "tss", cost.alias("cost"), F.lit(0).cast("bigint").alias("cut")))
    layers = [layer]

    for c in range(2, min(n, m) + 1):
        wide, small = [(c, m, c - 1, m - 1)], []
        while wide:
            small += [(*s, 0.0, 0.0, 0.0) for s in wide if s[1] - s[0] + s[3] - s[2] <= task]
            wide = [s for s in wide if s[1] - s[0] + s[3] - s[2] > task]  # about one for every ``task`` values
            if not wide:
                break
            mids = [(lo + hi) // 2 for lo, hi, _, _ in wide]
            at = {r["i"]: (r["tn"], r["ts"], r["tss"]) for r in layers[0].where(F.col("i").isin(mids)).select("i", "tn", "ts", "tss").collect()}
            asked = [(lo, hi, a, min(b, j - 1), *at[j]) for (lo, hi, a, b), j in zip(wide, mids)]
            total = F.col("cost") + (F.col("mss") - F.col("tss")) - F.pow(F.col("ms") - F.col("ts"), 2) / (F.col("mn") - F.col("tn"))
            best = dict(_within(layer, asked, task, "a", "b").groupBy("sub").agg(F.min(F.struct(total.alias("t"), "i"))["i"].alias("i")).select("sub", "i").collect())
            small += [(j, j, best[k], best[k], 0.0, 0.0, 0.0) for k, j in enumerate(mids)]
            wide = [s for k, ((lo, hi, a, b), j) in enumerate(zip(wide, mids)) for s in ((lo, j - 1, a, best[k]), (j + 1, hi, best[k], b)) if s[0] <= s[1]]

        ranges = [r[:4] for r in small]

        def solve(ends: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
            return _solve(ranges[int(ends["sub"].iloc[0])], ends, cuts)

        ends, cuts = _within(layers[0], small, task, "lo", "hi"), _within(layer, small, task, "a", "b")
        ends, cuts = (rows.select("sub", *[F.col(k).alias(k) for k in names]) for rows, names in (
            (ends, ("i", "v", "tn", "ts", "tss")), (cuts, ("i", "tn", "ts", "tss", "cost"))))
        layer = materialize(ends.groupBy("sub").cogroup(cuts.groupBy("sub")).applyInPandas(solve, _LAYER))
        layers.append(layer)
    limits, j = [], m
    for made in reversed(layers):
        row = made.where(F.col("i") == j).select("v", "cut").first()
        limits.append(row["v"])
        j = row["cut"]
    low = layers[0].where("i = 1").first()["v"]
    release(counts, *layers)
    return spark.createDataFrame([([low, *reversed(limits)],)], "breaks array<double>")
