"""Plain table work: calculated fields, sorting, sampling, splitting, unions, orders queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terraloom.functions.scalars import seeded
from terraloom.scale import global_row_number, running_total


def select_by_expression(df: DataFrame, expr: str) -> DataFrame:
    return df.where(expr)


def field_calc(df: DataFrame, name: str, expr: str, as_type: str | None = None) -> DataFrame:
    """New or replaced column from an SQL expression; a failed cast becomes null."""
    value = F.expr(expr)
    return df.withColumn(name, value.try_cast(as_type) if as_type else value)


def lookup_column(df: DataFrame, other: DataFrame, on: Sequence[str], col: str) -> DataFrame:
    """Add one column of another table by key."""
    return df.join(other.select(*on, col), list(on), "left")


def coerce_and_drop(df: DataFrame, dates: Sequence[str], numbers: Sequence[str], key: str) -> DataFrame:
    """To-date and to-number with bad values dropped; a null key becomes 0."""
    cols = {c: F.col(c).cast("string").try_cast("date") for c in dates}
    cols |= {c: F.col(c).cast("string").try_cast("double") for c in numbers}
    cols[key] = F.coalesce(F.col(key).cast("string").try_cast("double"), F.lit(0)).cast("int")
    return df.withColumns(cols).dropna(subset=[*dates, *numbers])


def order_by(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sort by (column, ascending) pairs."""
    return df.orderBy(*[F.col(k).asc() if up else F.col(k).desc() for k, up in keys])


def limit_features(df: DataFrame, n: int, keys: Sequence[Column | str]) -> DataFrame:
    """First n rows in order: a distributed top-n, never a full sort."""
    return df.orderBy(*keys).limit(n)


def random_column(key: Sequence[str], seed: int) -> Column:
    """Uniform number in [0, 1) from a row's key: the same on every run and every retry."""
    return seeded(seed, *[F.col(k) for k in key])


def sample(df: DataFrame, key: Sequence[str], fraction: float, seed: int) -> DataFrame:
    return df.where(random_column(key, seed) < fraction)


def split(df: DataFrame, key: Sequence[str], val: float, test: float, seed: int, at_least_one: bool = False) -> DataFrame:
    """Shuffle by the seeded column; train first, then val and test of int(n * share) rows."""
    placed = global_row_number(df.withColumn("_u", random_column(key, seed)), ["_u", *key], "_i").drop("_u")
    n = df.agg(F.count("*")).scalar()
    n_val, n_test = F.floor(n * F.lit(float(val))), F.floor(n * F.lit(float(test)))
    if at_least_one:
        n_val, n_test = F.greatest(n_val, F.lit(1)), F.greatest(n_test, F.lit(1))
    i = F.col("_i")
    return placed.withColumn(
        "split", F.when(i <= n - n_val - n_test, "train").when(i <= n - n_test, "val").otherwise("test")).drop("_i")


def merge_collections(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def key_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def key_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def first_per_group(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, found with partial aggregation."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m")).select(*key, "_m.*")


def renumber(df: DataFrame, order: Sequence[Column | str], out: str = "No") -> DataFrame:
    return global_row_number(df, order, out)


def categorize(df: DataFrame, col: str, out: str = "class_id") -> DataFrame:
    """Distinct values numbered 1..k in order; only the distinct values are ordered."""
    ids = running_total(df.where(F.col(col).isNotNull()).select(col).distinct(), [col], out=out)
    return df.join(ids.withColumn(out, F.col(out).cast("int")), col, "left")


def ordered_labels(col: Column, labels: Sequence[str]) -> Column:
    """Number of a label in a fixed order, 0 when unknown."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for i, s in enumerate(labels) for v in (s, i + 1)]), col), F.lit(0))


# --- ice-cream orders: customers, flavours, orders, order items ------------------------------

def orders_due(orders: DataFrame, customers: DataFrame, today: str, days: int = 2) -> DataFrame:
    """Orders due from today until ``days`` ahead, with their customer."""
    start = F.lit(today).cast("date")
    due = orders.where((F.col("due") >= start) & (F.col("due") <= F.date_add(start, days)))
    return due.join(customers, "customer")


def quantity_per_flavour(orders: DataFrame, items: DataFrame, flavours: DataFrame, customers: DataFrame, where: str) -> DataFrame:
    """Ordered quantity per flavour; items are summed per (order, flavour) before the joins."""
    per = items.groupBy("order", "flavour").agg(F.sum("quantity").alias("quantity"))
    chosen = orders.join(customers, "customer").where(where).select("order")
    return per.join(chosen, "order").groupBy("flavour").agg(F.sum("quantity").alias("quantity")).join(
        flavours, "flavour").select("flavour", "flavour_name", "quantity")
