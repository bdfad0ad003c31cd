"""Species statistics per cell, period or any other key.

Every operator first reduces occurrences to one row per (key, species, year); that
table is bounded by species x years per key, so a key holding any share of the raw
rows is already small before it is gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from terraloom.functions.scalars import classify_tier
from terraloom.scale import average_rank, global_row_number, materialize, parts_for, shuffled, with_totals

CELL = ("q", "r")


def harmonize(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace exact matches of ``col``; keep the old value in ``<col>_original``."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return df.withColumns({
        f"{col}_original": F.col(col),
        col: F.coalesce(F.element_at(F.create_map(*pairs), F.col(col)), F.col(col)),
    })


def filter_species(df: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col("species").isin(*include) & ~F.col("species").isin(*exclude))


def species_list(col: Column | str) -> Column:
    """Sorted distinct values joined by ', ' (aggregate)."""
    return F.array_join(F.array_sort(F.collect_set(col)), ", ")


def species_years(occ: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Records per (key, species, year), placed by key so later steps need no shuffle.

    Also accepts its own output, so a pipeline may compact the raw rows once, store the
    small table and feed it to every operator of this module.
    """
    if "rec" in occ.columns:
        aggs = [F.sum("rec").alias("rec"), F.min("rid").alias("rid")]
    else:
        aggs = [F.count("*").alias("rec"), F.min("rid").alias("rid")]
    return occ.groupBy(*by, "species", "yr").agg(*aggs).repartition(parts_for(occ.sparkSession, 0), *(by or ["species"]))


def profile(occ: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Species-year rows with per-species and per-year totals beside them.

    ``sp_first`` marks one row per (key, species) and ``yr_first`` one per (key, year), so
    every statistic below is a single aggregation over one scan and one placement by key.
    Windows hold at most species x years rows of a key.
    """
    species = W.partitionBy(*by, "species")
    year = W.partitionBy(*by, "yr")
    return species_years(occ, by).withColumns({
        "sp_rec": F.sum("rec").over(species),
        "sp_rid": F.min("rid").over(species),
        "sp_first": (F.row_number().over(species.orderBy("yr")) == 1) & F.col("species").isNotNull(),
        "yr_rec": F.sum("rec").over(year),
        "yr_sp": F.count("species").over(year),
        "yr_first": (F.row_number().over(year.orderBy("species")) == 1) & F.col("yr").isNotNull(),
    })


def survey_years(occ: DataFrame) -> list[int]:
    """Distinct years (bounded by the calendar)."""
    return [r[0] for r in occ.where("yr is not null").select("yr").distinct().orderBy("yr").collect()]


def trend_class(slope: Column, n: Column, default: str) -> Column:
    return F.when(n < 2, default).when(slope > 0.01, "Increasing").when(slope < -0.01, "Decreasing").otherwise("Stable")


def _slope(n: Column, x: Column, y: Column) -> Column:
    """Least-squares slope from exact integer sums; rows with NULL x and y do not count."""
    x, y = x.cast("bigint"), y.cast("bigint")
    top = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    low = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    return F.when(n >= 2, F.try_divide(top.cast("double"), low.cast("double"))).otherwise(F.lit(0e0))


def _yearly() -> list[Column]:
    """Slope of yearly richness and number of years of a profile."""
    first = F.col("yr_first")
    n = F.count_if(first)
    return [_slope(n, F.when(first, F.col("yr")), F.when(first, F.col("yr_sp"))).alias("_s"), n.alias("n_years")]


def linear_trend(occ: DataFrame, by: Sequence[str] = CELL, default: str = "No Data") -> DataFrame:
    """Richness trend over the years of each key; the class uses the unrounded slope."""
    t = profile(occ, by).groupBy(*by).agg(*_yearly()).where("n_years > 0")
    return t.select(
        *by, F.round("_s", 4).alias("trend_slope"), trend_class(F.col("_s"), F.col("n_years"), default).alias("trend"),
        "n_years",
    )


def _year_tests(years: Sequence[int], given: bool) -> dict[str, Column]:
    """A test per column suffix; years that the caller did not list are counted together as ``other``."""
    tests = {str(y): F.col("yr") == y for y in years}
    return {**tests, "other": F.col("yr").isNotNull() & ~F.col("yr").isin(list(years))} if given else tests


def _per_year(col: str, tests: Mapping[str, Column], name: str) -> list[Column]:
    return [F.sum(F.when(F.col("yr_first") & test, F.col(col)).otherwise(0)).alias(f"{name}_{y}") for y, test in tests.items()]


def cell_summary(
    occ: DataFrame, grid: DataFrame, by: Sequence[str] = CELL, years: Sequence[int] | None = None
) -> DataFrame:
    """Per grid cell: records, richness, species, years, yearly records and trend; empty cells kept.

    Given ``years`` get a column each, all others one together.
    """
    tests = _year_tests(survey_years(occ) if years is None else years, years is not None)
    stats = profile(occ, by).groupBy(*by).agg(
        F.sum("rec").alias("total_records"),
        F.count_if("sp_first").alias("species_richness"),
        species_list("species").alias("species_list"),
        *_yearly(),
        F.min("yr").alias("first_year"),
        F.max("yr").alias("last_year"),
        *_per_year("yr_rec", tests, "records"),
    )
    zero = {c: 0 for c in ["total_records", "species_richness", "n_years", *[f"records_{y}" for y in tests]]}
    out = grid.join(shuffled(stats), list(by), "left").fillna({**zero, "species_list": "", "_s": 0.0})
    return out.withColumns({
        "trend_slope": F.round("_s", 4), "trend": trend_class(F.col("_s"), F.col("n_years"), "No Data"),
    }).drop("_s")


def diversity(occ: DataFrame, by: Sequence[str] = CELL, common: Mapping[str, str] | None = None) -> DataFrame:
    """Shannon, Simpson, Pielou, Berger-Parker, dominant species and trend per key."""
    by = list(by)
    first, n = F.col("sp_first"), F.when(F.col("sp_first"), F.col("sp_rec"))
    order = F.when(first, F.struct(-F.col("sp_rec"), "sp_rid", "species"))
    base = profile(occ, by).where("species is not null").groupBy(*by).agg(
        F.count_if(first).alias("s"),
        F.sum(n).alias("n"),
        F.sum(n * F.log(n)).alias("_nln"),
        F.sum(n * n).alias("_nn"),
        F.max(n).alias("_max"),
        F.min_by("species", order).alias("dominant_species"),
        *_yearly(),
    )
    total, s = F.col("n").cast("double"), F.col("s")
    h = F.when(s > 1, F.log(total) - F.col("_nln") / total).otherwise(F.lit(0e0))
    pairs = [F.lit(v) for kv in (common or {}).items() for v in kv]
    name = F.coalesce(F.element_at(F.create_map(*pairs), F.col("dominant_species")), F.lit("")) if pairs else F.lit("")
    return base.select(
        *by, "s", "n",
        F.round(h, 4).alias("shannon_h"),
        F.round(1 - F.col("_nn") / (total * total), 4).alias("simpson_d"),
        F.round(F.when(s > 1, h / F.log(F.when(s > 1, s).otherwise(2))).otherwise(0e0), 4).alias("pielou_j"),
        F.round(F.col("_max") / total, 4).alias("berger_parker"),
        "dominant_species",
        name.alias("common_name"),
        trend_class(F.col("_s"), F.col("n_years"), "Stable").alias("trend"),
        F.round("_s", 4).alias("trend_slope"),
    )


def _chao1_columns(s: str = "s_obs", f1: str = "f1", f2: str = "f2") -> Column:
    s, f1, f2 = F.col(s), F.col(f1), F.col(f2)
    return (
        F.when(f2 > 0, s + f1 * f1 / (2e0 * F.when(f2 > 0, f2).otherwise(1)))
        .when(f1 > 0, s + f1 * (f1 - 1) / 2e0)
        .otherwise(s.cast("double"))
    )


def chao1(occ: DataFrame, by: Sequence[str] = CELL, years: bool = True, coverage: bool = False) -> DataFrame:
    """Chao1 estimate and completeness per key; optional survey years and sample coverage."""
    by = list(by)
    n = F.when(F.col("sp_first"), F.col("sp_rec"))
    aggs = [
        F.sum("rec").alias("n"), F.count_if("sp_first").alias("s_obs"),
        F.count_if(n == 1).alias("f1"), F.count_if(n == 2).alias("f2"),
    ]
    if years:
        years_seen = F.array_sort(F.collect_set("yr"))
        aggs += [
            F.count_if("yr_first").alias("years_surveyed"),
            F.array_join(F.transform(years_seen, lambda y: y.cast("string")), ", ").alias("survey_years"),
        ]
    base = profile(occ, by) if "yr" not in by else species_years(occ, by).withColumns({
        "sp_rec": F.col("rec"), "sp_first": F.col("species").isNotNull()})
    est = base.groupBy(*by).agg(*aggs).withColumn("_c", _chao1_columns())
    cols = [
        F.round("_c", 2).alias("chao1"),
        F.when(F.col("_c") > 0, F.round(F.col("s_obs") / F.col("_c") * 100, 1)).otherwise(100e0).alias("completeness_pct"),
    ]
    if coverage:
        cols.append(F.round(1 - F.col("f1") / F.col("n"), 4).alias("coverage"))
    else:
        cols.append(F.round(F.col("_c") - F.col("s_obs"), 1).alias("undetected"))
    return est.select(*by, "n", "s_obs", "f1", "f2", *cols, *(["years_surveyed", "survey_years"] if years else []))


def chao1_per_period(occ: DataFrame) -> DataFrame:
    return chao1(occ.where("yr is not null"), ["yr"], years=False, coverage=True)


def chao1_comparison(occ: DataFrame, since: int, label: str) -> DataFrame:
    """Chao1 of all records beside the records since a year, in one pass over the data."""
    recent = F.col("yr") >= since
    counts = species_years(occ, []).groupBy("species").agg(
        F.sum("rec").alias("full"), F.sum(F.when(recent, F.col("rec")).otherwise(0)).alias("recent"))
    both = counts.select("species", F.explode(F.create_map(F.lit("Full"), "full", F.lit(label), "recent")).alias("dataset", "rec"))
    base = both.where("rec > 0").groupBy("dataset").agg(
        F.sum("rec").alias("n"), F.count("species").alias("s_obs"),
        F.count_if(F.col("rec") == 1).alias("f1"), F.count_if(F.col("rec") == 2).alias("f2"),
    )
    est = base.withColumn("_c", _chao1_columns())
    return est.select(
        "dataset", "n", "s_obs", "f1", "f2", F.round("_c", 2).alias("chao1"),
        F.when(F.col("_c") > 0, F.round(F.col("s_obs") / F.col("_c") * 100, 1)).otherwise(100e0).alias("completeness_pct"),
    )


def effort_per_period(occ: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Records and distinct species, cells and methods per year."""
    rec = F.sum("rec") if "rec" in occ.columns else F.count("*")
    small = occ.where("yr is not null").groupBy("yr", "species", *cell, "method").agg(rec.alias("rec"))
    return small.groupBy("yr").agg(
        F.sum("rec").alias("records"),
        F.count_distinct("species").alias("n_species"),
        F.count_distinct(F.struct(*cell)).alias("n_cells"),
        F.count_distinct("method").alias("n_methods"),
        species_list("method").alias("method_list"),
    )


def temporal_matrix(
    occ: DataFrame, grid: DataFrame, by: Sequence[str] = CELL, years: Sequence[int] | None = None
) -> DataFrame:
    """Records and species per cell and year, side by side."""
    tests = _year_tests(survey_years(occ) if years is None else years, years is not None)
    wide = profile(occ, by).where("yr_first").groupBy(*by).agg(
        *_per_year("yr_rec", tests, "records"), *_per_year("yr_sp", tests, "species"),
        F.sum("yr_rec").alias("total_records"), F.count("*").alias("years_with_data"),
    )
    out = grid.join(shuffled(wide), list(by), "left")
    out = out.fillna(0, [c for c in wide.columns if c not in by])
    return out.withColumn("status", F.when(F.col("total_records") > 0, "Occupied").otherwise("Empty"))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def student_p(rho: Column, df_: Column) -> Column:
    """Two-sided p-value of a correlation with ``df_`` degrees of freedom.

    For whole degrees of freedom the t distribution is a finite sum in
    sin(theta) = abs(rho), so no numeric integration is needed.
    """
    s, c2 = F.abs(rho), F.greatest(1 - rho * rho, F.lit(0e0))
    odd = df_ % 2 == 1
    first = F.when(odd, F.sqrt(c2)).otherwise(F.lit(1e0))
    steps = F.when(odd, (df_ - 3) / 2).otherwise((df_ - 2) / 2).cast("int")
    terms = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        terms,
        F.struct(first.alias("term"), first.alias("sum")),
        lambda acc, k: F.struct(
            (acc["term"] * c2 * F.when(odd, 2 * k / (2 * k + 1e0)).otherwise((2 * k - 1) / (2e0 * k))).alias("term"),
            (acc["sum"] + acc["term"] * c2 * F.when(odd, 2 * k / (2 * k + 1e0)).otherwise((2 * k - 1) / (2e0 * k))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    inner = F.when(df_ == 1, F.lit(0e0)).otherwise(total)
    a = F.when(odd, (F.asin(s) + s * inner) * (2 / 3.141592653589793)).otherwise(s * inner)
    return F.greatest(1 - a, F.lit(0e0))


def spearman_trend(occ: DataFrame, common: Mapping[str, str] | None = None) -> DataFrame:
    """Rank correlation of yearly record counts with the year, per species with 3 years or more."""
    # records without a year still belong to the species total
    by_year = species_years(occ, []).withColumn("total_records", F.sum("rec").over(W.partitionBy("species")))
    yearly = by_year.where("yr is not null").select("species", "yr", "total_records", F.col("rec").alias("n"))
    per = W.partitionBy("species")  # one row per calendar year
    ranked = yearly.withColumns({
        "ry": F.rank().over(per.orderBy("yr")).cast("double"),
        "rn": F.rank().over(per.orderBy("n")) + (F.count("*").over(W.partitionBy("species", "n")) - 1) / 2e0,
    })
    rho = ranked.groupBy("species").agg(
        F.count("*").alias("n_years"), F.first("total_records").alias("total_records"),
        F.when(F.min("n") == F.max("n"), F.lit(None).cast("double")).otherwise(F.corr("ry", "rn")).alias("_rho"),
    ).where("n_years >= 3")
    pairs = [F.lit(v) for kv in (common or {}).items() for v in kv]
    name = F.coalesce(F.element_at(F.create_map(*pairs), F.col("species")), F.lit("")) if pairs else F.lit("")
    return rho.select(
        "species", name.alias("common_name"), "n_years", "total_records",
        F.round("_rho", 4).alias("rho"),
        F.round(student_p(F.col("_rho"), F.col("n_years") - 2), 4).alias("p_value"),
        F.when(F.col("_rho") > 0.3, "Increasing").when(F.col("_rho") < -0.3, "Decreasing").otherwise("Stable").alias("trend"),
    )


def spearman_matrix(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rank correlation of every column pair as rows (a, b, rho)."""
    long = df.select(*key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])).alias("p")
    ).select(*key, "p.name", "p.value")
    ranks = average_rank(long, "value", ["name"])
    wide = ranks.groupBy(*key).agg(*[F.max(F.when(F.col("name") == c, F.col("rank"))).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 4).alias("rho"))
        for a, b in pairs])).alias("p")).select("p.*")


def co_occurrence(occ: DataFrame, grid: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Species pairs per cell, zero where empty."""
    s = occ.select(*by, "species").distinct().groupBy(*by).agg(F.count("species").alias("n_species"))
    s = s.withColumn("n_pairs", F.col("n_species") * (F.col("n_species") - 1) / 2e0)
    return grid.join(shuffled(s), list(by), "left").fillna({"n_pairs": 0.0})


def threatened_count(occ: DataFrame, names: Sequence[str], by: Sequence[str] = CELL) -> DataFrame:
    return occ.select(*by, "species").distinct().groupBy(*by).agg(
        F.count_if(F.col("species").isin(*names)).alias("threatened"))


def minmax_normalize(df: DataFrame, cols: Sequence[str], prefix: str = "n_") -> DataFrame:
    """Scale columns to 0..1 over all rows; a constant column becomes 0."""
    t = with_totals(df, [a for c in cols for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    return t.withColumns({
        f"{prefix}{c}": F.coalesce(
            F.try_divide((F.col(c) - F.col(f"_totals.lo_{c}")).cast("double"),
                         (F.col(f"_totals.hi_{c}") - F.col(f"_totals.lo_{c}")).cast("double")),
            F.when(F.col(c).isNotNull(), 0e0))
        for c in cols}).drop("_totals")


def priority_index(df: DataFrame, weights: Mapping[str, float], by: Sequence[str] = CELL) -> DataFrame:
    """Weighted sum of normalized parts, ranked from the highest; ties follow the cell key."""
    score = sum((F.col(f"n_{c}") * F.lit(w) for c, w in weights.items()), F.lit(0e0))
    scored = minmax_normalize(materialize(df), list(weights)).withColumn("priority_index", F.round(score, 4)).drop(
        *[f"n_{c}" for c in weights])
    tier = classify_tier(F.col("priority_index"), [0.7, 0.5, 0.3], ["CRITICAL", "HIGH", "MEDIUM", "LOW"], inclusive=True)
    return global_row_number(
        scored.withColumn("tier", tier), [F.desc("priority_index"), *by], out="priority_rank")


def temporal_turnover(
    occ: DataFrame, grid: DataFrame, by: Sequence[str] = CELL, recent_from: int = 2020,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Species gained and lost between successive surveyed years of a cell."""
    tests = _year_tests(survey_years(occ) if years is None else years, years is not None)
    by = list(by)
    sy = species_years(occ, by).where("yr is not null and species is not null")
    sets = sy.groupBy(*by, "yr").agg(F.collect_set("species").alias("sp"))
    prev = F.lag("sp").over(W.partitionBy(*by).orderBy("yr"))  # one row per calendar year
    step = sets.withColumn("prev", prev).select(
        *by, "yr", F.col("sp").alias("sets"),
        F.size(F.array_except("sp", "prev")).alias("gained"),
        F.size(F.array_except("prev", "sp")).alias("lost"),
        F.size(F.array_union("prev", "sp")).alias("both"),
        F.col("prev").isNotNull().alias("has_prev"),
    )
    gone = F.when(F.col("has_prev"), F.col("gained") + F.col("lost"))
    time = step.groupBy(*by).agg(
        _slope(F.count("*"), F.col("yr"), F.size("sets")).alias("_s"),
        F.min("yr").alias("first_detected"), F.max("yr").alias("last_detected"),
        F.count("*").alias("years_detected"),
        F.sum(F.when(F.col("has_prev"), F.col("gained")).otherwise(0)).alias("colonisations"),
        F.sum(F.when(F.col("has_prev"), F.col("lost")).otherwise(0)).alias("extinctions"),
        F.round(F.avg(gone / F.col("both")), 4).alias("mean_beta"),
        F.size(F.array_distinct(F.flatten(F.collect_list("sets")))).cast("bigint").alias("species_ever"),
        *[F.sum(F.when(test, F.size("sets")).otherwise(0)).alias(f"rich_{y}") for y, test in tests.items()],
    )
    out = grid.join(shuffled(time), by, "left")
    zero = ["years_detected", "colonisations", "extinctions", "mean_beta", "species_ever", *[f"rich_{y}" for y in tests]]
    out = out.fillna(0, zero)
    n = F.col("years_detected")
    return out.withColumns({
        "status": F.when(n == 0, "Never Detected").when(n >= 3, "Persistent")
        .when(F.col("last_detected") >= recent_from, "Recent").otherwise("Historical"),
        "richness_trend": F.when(n == 0, "No Data").otherwise(trend_class(F.col("_s"), n, "Stable")),
    }).drop("_s")
