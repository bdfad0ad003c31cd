"""Building blocks that keep ordered and skewed work spread over the cluster.

Spark evaluates a window without PARTITION BY, and any window over one hot key, in a
single task.  The helpers here express the same results (global row numbers, running
totals, exact percentiles, average ranks) as range-partitioned work, so the largest
group may hold any share of the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W


def work_dir(spark: SparkSession) -> str:
    """Folder of this application for tables that cut lineage, reachable by every executor.

    Lies under ``spark.checkpoint.dir``, or under the session's warehouse where that is
    unset; on a cluster the latter must not be a folder of one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and (base.startswith("file:") or "://" not in base):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share; the warehouse is on one machine")
    return f"{base.rstrip('/')}/terraloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Spark's setting that the files a query shuffled go as soon as it ends, not when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage for loops, freezes partition ids and gives the next stage exact sizes,
    column pruning and statistics.  The table outlives any executor; ``release`` deletes
    it, ``clean_up`` all that are left.  What was shuffled for it is deleted at once.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._terraloom_path = path
    return made


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made; nothing derived from them may be read later."""
    for df in tables:
        path = getattr(df, "_terraloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables of this application; call it when its results have been consumed."""
    _delete(spark, work_dir(spark))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose sides both grow with the input: the join shuffles both.

    Spark's estimate knows neither rows that ``explode`` adds nor how well Parquet packs a
    column, so a side of any size may pass for small and be gathered by the driver.
    """
    return df.hint("merge")


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int, share: int = 500_000) -> int:
    """Partitions for rows that a step makes after they were placed: the session's number, more if one would make over ``share``.

    Adaptive execution merges partitions by the bytes that were shuffled, so a few rows from
    which very many are made end in one task unless their number of partitions is given.
    """
    return max(_width(spark), -(-int(rows) // share))


def running_totals(df: DataFrame, order: Sequence[Column | str], weights: Mapping[str, Column | str], keys: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums, one column for each of ``weights``, in ``order``, per ``keys``.

    Range partitioning on (keys, order) bounds every task; only one total per
    (key, range) is combined across tasks.  ``order`` must make rows distinct within a key.
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    named = {f"_w{k}": F.expr(w) if isinstance(w, str) else w for k, w in enumerate(weights.values())}
    placed = materialize(
        df.withColumns(named)
        .repartitionByRange(_width(df.sparkSession), *keys, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_range")
        .agg(*[F.sum(w).alias(f"_sum{w}") for w in named])
        .select(*keys, "_range", *[F.coalesce(F.sum(f"_sum{w}").over(before), F.lit(0)).alias(f"_offset{w}") for w in named])
    )
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.join(offsets, [*keys, "_range"])
        .withColumns({out: F.col(f"_offset{w}") + F.sum(w).over(inside) for out, w in zip(weights, named)})
        .drop(*named, "_range", *[f"_offset{w}" for w in named])
    )


def running_total(
    df: DataFrame,
    order: Sequence[Column | str],
    weight: Column | str = "1",
    keys: Sequence[str] = (),
    out: str = "running",
) -> DataFrame:
    """One running sum; see :func:`running_totals`."""
    return running_totals(df, order, {out: weight}, keys)


def global_row_number(df: DataFrame, order: Sequence[Column | str], out: str = "row_number") -> DataFrame:
    """1..n in ``order`` over all rows without a single-task window."""
    return running_total(df, order, out=out).withColumn(out, F.col(out).cast("bigint"))


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Add the tie-averaged rank of ``value`` per ``keys``; one row per value is ranked."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranks = running_total(counts, [value], "_n", keys, "_cum").select(
        *keys, value, (F.col("_cum") - (F.col("_n") - 1) / 2e0).alias(out)
    )
    return df.join(shuffled(ranks), [*keys, value])


def exact_percentiles(
    df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolated percentiles per ``keys``.

    The built-in exact ``percentile`` keeps every distinct value of a group in one
    buffer; here values are counted, range partitioned and looked up by position.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cum = running_total(counts, [value], "_n", keys, "_cum")
    total = cum.groupBy(*keys).agg(F.max("_cum").alias("_total"))
    if keys:
        cum = cum.join(total, keys)
    else:
        cum = cum.withColumn("_total", total.scalar())
    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [
            F.min(F.when(F.col("_cum") > F.floor(pos), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_f_{name}"),
        ]
    got = cum.groupBy(*keys).agg(*picks)
    return got.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )


def with_totals(df: DataFrame, aggs: Sequence[Column]) -> DataFrame:
    """Attach one-row aggregates of ``df`` to every row as a scalar subquery."""
    one = df.agg(F.struct(*aggs).alias("_t"))
    return df.withColumn("_totals", one.scalar())
