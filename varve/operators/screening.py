"""Screening of series against a target by correlation with effective degrees of freedom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScreeningConfig
from ..functions.stats import benjamini_hochberg, constant, correlation, effective_n, holm, student_p, t_value
from .temporal import annualize, complete_window_pairs, linear_detrend, native_resolution


def lag_one(pairs: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """(keys, lag_x, lag_y, adjacent): correlations of neighbours exactly ``step`` apart, clipped to 0.99; 0 where they can't be told."""
    order = Window.partitionBy(*keys).orderBy("year")
    rows = pairs.withColumns({"next_year": F.lead("year").over(order), "x2": F.lead("x").over(order), "y2": F.lead("y").over(order)})
    near = F.coalesce((F.col("next_year") - F.col("year")) == F.col(step), F.lit(False))
    only = lambda c: F.when(near, F.col(c))
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(near.cast("long")).alias("adjacent"),
        correlation(only("x"), only("x2")).alias("rx"),
        correlation(only("y"), only("y2")).alias("ry"),
        constant(F.col("x")).alias("flat_x"),
        constant(F.col("y")).alias("flat_y"),
    )

    def clipped(r: str, flat: str):
        usable = (F.col("n") >= 3) & (F.col("adjacent") >= 2) & ~F.col(flat)
        return F.when(usable, F.coalesce(F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col(r))), F.lit(0.0))).otherwise(F.lit(0.0))

    return got.select(*keys, clipped("rx", "flat_x").alias("lag_x"), clipped("ry", "flat_y").alias("lag_y"), "adjacent")


def effective_correlation(pairs: DataFrame, keys: Sequence[str] = ("pid",), step: str | int = 1, with_p: bool = True) -> DataFrame:
    """(keys, n, r, n_eff, t[, p]) of rows (keys, year, x, y); missing r where fewer than three pairs or no variation."""
    rows = pairs.where("x is not null and y is not null")
    if isinstance(step, int):
        rows, step = rows.withColumn("__step", F.lit(step)), "__step"
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("r"))
    out = base.join(lag_one(rows, keys, step), list(keys))
    out = out.withColumn("r", F.when(F.col("n") >= 3, F.col("r"))).withColumn("n_eff", effective_n(F.col("n"), F.col("lag_x"), F.col("lag_y")))
    out = out.withColumn("t", t_value(F.col("r"), F.col("n_eff")))
    out = out.select(*keys, "n", "r", "n_eff", "t", "adjacent")
    return out.withColumn("p", student_p(F.abs("t"), F.greatest(F.col("n_eff") - 2, F.lit(1.0)))) if with_p else out


def candidate_pairs(obs: DataFrame, target: DataFrame, cfg: ScreeningConfig) -> DataFrame:
    """(pid, season, pairing, step, year, x, y) of every season to test. target has year and y.

    Series finer than 0.75 years are tested for each candidate season; others once. Series coarser than
    the cutoff meet the target in whole native windows.
    """
    resolution = native_resolution(obs).cache()
    seasons = [cfg.months] if cfg.season_mode == "fixed" else list(dict.fromkeys(cfg.season_candidates))
    fine = F.coalesce(F.col("resolution") < 0.75, F.lit(False))
    coarse = (F.col("resolution") > cfg.native_window_cutoff) if cfg.pairing == "window" else F.lit(False)
    coarse = F.coalesce(coarse, F.lit(False))
    start, end = cfg.period if cfg.period else target.where("y is not null").agg(F.min("year"), F.max("year")).first()
    local = target.where(F.col("year").between(start, end)) if cfg.period else target
    kinds = resolution.withColumns({"fine": fine, "coarse": coarse})

    def annual(months: tuple[int, ...], name: str, who: DataFrame) -> DataFrame:
        rows = obs.join(who.select("pid"), "pid", "left_semi")
        series = annualize(rows, months, cfg.anchor, cfg.month_fraction, resolution)
        if cfg.period:
            series = series.where(F.col("year").between(start, end))
        t = local
        if cfg.detrend:
            series = linear_detrend(series)
            t = linear_detrend(t.select(F.lit("t").alias("pid"), "year", F.col("y").alias("value")).dropna()).select("year", F.col("value").alias("y"))
        return series.join(t, "year").select("pid", F.lit(name).alias("season"), F.lit("annual").alias("pairing"), F.lit(1).alias("step"), "year", F.col("value").alias("x"), "y")

    label = lambda months: ",".join(map(str, months))
    out = annual(cfg.months, label(cfg.months), kinds.where("not fine and not coarse"))
    for months in seasons:
        out = out.unionByName(annual(months, label(months), kinds.where("fine")))
    widths = kinds.where("coarse").select("pid", F.coalesce(F.array_min(F.filter(F.array(*[F.lit(b) for b in cfg.native_window_bins]), lambda b: b >= F.col("resolution"))), F.ceil("resolution").cast("int")).alias("step"))
    for (width,) in widths.select("step").distinct().collect():
        rows = obs.join(widths.where(F.col("step") == width).select("pid"), "pid", "left_semi")
        pairs = complete_window_pairs(rows, local, start, end, width)
        out = out.unionByName(pairs.select("pid", F.lit(label(cfg.months)).alias("season"), F.lit("native_window").alias("pairing"), F.lit(width).alias("step"), F.col("window_id").alias("year"), "x", "y"))
    return out


def best_season(tests: DataFrame, cfg: ScreeningConfig, seasons: Sequence[str]) -> DataFrame:
    """One row per pid of rows (pid, season, n, r, p, resolution): p adjusted over its seasons, then the strongest that has overlap enough."""
    required = F.when(F.coalesce(F.col("resolution") >= cfg.low_resolution_cutoff, F.lit(False)), F.lit(cfg.low_resolution_min_overlap or cfg.min_overlap)).otherwise(F.lit(cfg.min_overlap))
    order = {s: k for k, s in enumerate(seasons)}
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("season")), F.lit(len(order)))
    rows = tests.withColumns({"required": required, "season_rank": rank})
    rows = holm(rows, "p", "p_adjusted", ["pid"], ["season_rank"]) if cfg.multiple_testing == "holm" else rows.withColumn("p_adjusted", F.col("p"))
    pick = Window.partitionBy("pid").orderBy((F.col("n") >= F.col("required")).desc(), F.abs("r").desc_nulls_last(), "season_rank")
    rows = rows.withColumns({"place": F.row_number().over(pick), "seasons_tested": F.count(F.lit(1)).over(Window.partitionBy("pid"))}).where("place = 1")
    passes = (F.col("n") >= F.col("required")) & (F.abs("r") >= cfg.r_threshold) & (F.col("p_adjusted") <= cfg.p_threshold)
    return rows.withColumn("passes", F.coalesce(passes, F.lit(False))).drop("place", "season_rank")


def archive_top(screened: DataFrame, limits: Sequence[tuple[str, int]]) -> DataFrame:
    """Rank the selected series of each limited archive and keep the first ones; adds archive_rank and excluded_by_cap."""
    table = F.create_map(*[F.lit(x) for name, k in limits for x in (name.strip().lower(), k)]) if limits else None
    limit = F.element_at(table, F.lower(F.trim("archive"))) if limits else F.lit(None).cast("int")
    order = Window.partitionBy(F.lower(F.trim("archive")), "selected").orderBy(F.col("p_proxy").asc_nulls_last(), F.abs("r").desc_nulls_last(), F.col("n_eff").desc_nulls_last(), "pid")
    rows = screened.withColumn("cap", limit).withColumn("archive_rank", F.when(F.col("selected") & F.col("cap").isNotNull(), F.row_number().over(order)))
    out = rows.withColumn("excluded_by_cap", F.coalesce(F.col("archive_rank") > F.col("cap"), F.lit(False)))
    return out.withColumns({"selected_before_cap": F.col("selected"), "selected": F.col("selected") & ~F.col("excluded_by_cap")}).drop("cap")


def screen(obs: DataFrame, records: DataFrame, target: DataFrame, cfg: ScreeningConfig = ScreeningConfig()) -> DataFrame:
    """The screening table: one row per record, with its best season, tests, adjusted p and selection."""
    obs = obs.join(records.select("pid"), "pid", "left_semi")
    pairs = candidate_pairs(obs, target, cfg)
    tests = effective_correlation(pairs, ["pid", "season", "pairing", "step"], "step")
    resolution = native_resolution(obs)
    seasons = [",".join(map(str, m)) for m in (cfg.months, *cfg.season_candidates)]
    best = best_season(tests.join(resolution, "pid"), cfg, seasons)
    rows = records.select("pid", "archive", "proxy", "lat", "lon").join(best, "pid", "left")
    adjust = {"fdr_bh": benjamini_hochberg, "holm": holm}.get(cfg.proxy_multiple_testing)
    rows = adjust(rows, "p_adjusted", "p_proxy", (), ["pid"]) if adjust else rows.withColumn("p_proxy", F.col("p_adjusted"))
    rows = rows.withColumn("selected", F.coalesce(F.col("passes") & (F.col("p_proxy") <= cfg.p_threshold), F.lit(False)))
    return archive_top(rows, cfg.archive_max_counts).orderBy(F.desc("selected"), F.col("p_proxy").asc_nulls_last(), "pid")
