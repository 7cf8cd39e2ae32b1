"""Skill, folds, memberships of sensitivity runs, and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation


def skill(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Skill of rows (keys, observed, predicted, calibration_mean): RE refers to the calibration mean, CE to the validation mean; without a calibration mean both refer to the latter."""
    rows = rows.where("observed is not null and predicted is not null")
    y, p = F.col("observed"), F.col("predicted")
    residual = y - p
    away = y - F.col("calibration_mean")
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(residual * residual).alias("sse"), F.avg(residual * residual).alias("mse"), F.avg(F.abs(residual)).alias("mae"), F.avg(p - y).alias("bias"),
        F.stddev_samp(y).alias("observed_sd"), F.stddev_samp(p).alias("predicted_sd"), F.var_pop(y).alias("vy"), F.sum(away * away).alias("re_den"), correlation(y, p).alias("r"),
    )
    ce_den = F.col("vy") * F.col("n")
    one = lambda den: F.when(den > 0, 1 - F.col("sse") / den)
    got = got.withColumns({"rmse": F.sqrt("mse"), "sd_ratio": F.try_divide("predicted_sd", "observed_sd"), "ce": one(ce_den), "re": one(F.coalesce("re_den", ce_den))})
    return got.select(*keys, "n", "r", "rmse", "mae", "bias", "observed_sd", "predicted_sd", "sd_ratio", (F.col("sd_ratio") * F.col("sd_ratio")).alias("variance_ratio"), F.col("ce").alias("r2_skill"), "re", "ce")


def contiguous_folds(years: DataFrame, block: int, keys: Sequence[str] = (), least_train: int = 20) -> DataFrame:
    """(keys, year, fold): consecutive blocks to be held out, at most a third wide; a remainder of one year joins the block before. Without enough years there are none."""
    by = Window.partitionBy(*keys)
    rows = years.select(*keys, "year").distinct().withColumns({"i": F.row_number().over(by.orderBy("year")) - 1, "n": F.count(F.lit(1)).over(by)})
    width = F.least(F.lit(block), F.greatest(F.lit(2), F.floor((F.col("n") + 2) / 3))).cast("int")
    fold = F.floor(F.col("i") / F.col("w")).cast("int")
    last = F.floor((F.col("n") - 1) / F.col("w")).cast("int")
    rows = rows.where(F.col("n") >= least_train + 2).withColumn("w", width).withColumn("fold", fold)
    rows = rows.withColumn("fold", F.when((F.col("n") % F.col("w") == 1) & (F.col("n") > F.col("w")) & (F.col("fold") == last), F.col("fold") - 1).otherwise(F.col("fold")))
    rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "fold")))
    return rows.where((F.col("n") - F.col("size") >= least_train) & (F.col("size") >= 2)).select(*keys, "year", "fold")


def edge_folds(years: DataFrame, fraction: float, keys: Sequence[str] = (), least_train: int = 20) -> DataFrame:
    """(keys, year, fold): the early part (0) and the late part (1)."""
    by = Window.partitionBy(*keys)
    rows = years.select(*keys, "year").distinct().withColumns({"i": F.row_number().over(by.orderBy("year")), "n": F.count(F.lit(1)).over(by)})
    rows = rows.withColumn("k", F.greatest(F.lit(2), F.ceil(F.col("n") * fraction)).cast("int")).where((F.col("n") >= least_train + 2) & (F.col("n") - F.col("k") >= least_train))
    sides = F.array_compact(F.array(F.when(F.col("i") <= F.col("k"), F.lit(0)), F.when(F.col("i") > F.col("n") - F.col("k"), F.lit(1))))
    return rows.select(*keys, "year", F.explode(sides).alias("fold"))


def training_years(years: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, year): all years but the fold's own."""
    return years.select("year").distinct().crossJoin(folds.select("fold").distinct()).join(folds.select("fold", "year"), ["fold", "year"], "left_anti")


def outer_fold_table(years: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, validation_start, validation_end, holdout_position, held_years, train_years) of folds (fold, year)."""
    span = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.count_distinct("year").alias("n"))
    rows = folds.groupBy("fold").agg(F.min("year").alias("validation_start"), F.max("year").alias("validation_end"), F.count(F.lit(1)).alias("held_years"))
    position = holdout_position(F.col("validation_start"), F.col("validation_end"), F.col("lo"), F.col("hi"))
    # the span is one row
    return rows.join(F.broadcast(span)).select("fold", "validation_start", "validation_end", position.alias("holdout_position"), "held_years", (F.col("n") - F.col("held_years")).alias("train_years"))


def holdout_position(first: Column, last: Column, lo: Column, hi: Column) -> Column:
    return F.when(first == lo, "early").when(last == hi, "late").otherwise("middle")


def hash_holdout(rows: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """Adds held: a share of each group's years, chosen by a hash of key and year; the same in any engine."""
    place = F.md5(F.concat_ws(":", *keys, F.col("year").cast("string")))
    by = Window.partitionBy(*keys)
    rows = rows.withColumn("__place", place)
    k = F.row_number().over(by.orderBy("__place", "year"))
    return rows.withColumn("held", k <= F.ceil(F.count(F.lit(1)).over(by) * fraction)).drop("__place")


def leave_one_out(records: DataFrame) -> DataFrame:
    """(omitted, pid): each series left out once; its size is the square of the series, so it needs more than two and suits selected networks."""
    return records.select(F.col("pid").alias("omitted")).join(records.select("pid"), F.col("omitted") != F.col("pid"))


def random_deletion(records: DataFrame, repeats: int, fraction: float) -> DataFrame:
    """(run, pid): what stays when a share is deleted, chosen by a hash of run and pid."""
    rows = records.select("pid", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("run"))
    by = Window.partitionBy("run")
    k = F.row_number().over(by.orderBy(F.md5(F.concat_ws(":", F.col("run").cast("string"), "pid")), "pid"))
    return rows.withColumns({"k": k, "n": F.count(F.lit(1)).over(by)}).where(F.col("k") <= F.greatest(F.lit(2), F.ceil(F.col("n") * (1 - fraction)))).select("run", "pid")


def summarize(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, n, minimum, q05, q25, median, q75, q95, maximum)."""
    long = table.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "v").where("v is not null and not isnan(v)")
    got = long.groupBy("metric").agg(F.count("v").alias("n"), F.min("v").alias("minimum"), F.percentile("v", F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q"), F.max("v").alias("maximum"))
    return got.select("metric", "n", "minimum", *[F.col("q")[k].alias(n) for k, n in enumerate(("q05", "q25", "median", "q75", "q95"))], "maximum")


def summarize_folds(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Medians and 5 and 95 per cent quantiles of the skill columns that are there."""
    names = [c for c in ("r", "rmse", "mae", "bias", "r2_skill", "re", "ce") if c in folds.columns]
    parts = [F.count(F.lit(1)).alias("fold_count")]
    for c in names:
        parts += [F.median(c).alias(f"median_{c}"), F.percentile(c, F.lit(0.05)).alias(f"q05_{c}"), F.percentile(c, F.lit(0.95)).alias(f"q95_{c}")]
    return folds.groupBy(*keys).agg(*parts)


#: The skill columns that summaries of outer folds tell, and those they tell at the edges.
FOLD_METRICS = ("r", "p_effective", "n_eff", "rmse", "re", "ce", "sd_ratio", "variance_ratio")
EDGE_METRICS = ("r", "p_effective", "rmse", "re", "ce")


def summarize_modes(folds: DataFrame, keys: Sequence[str] = ("validation_mode",)) -> DataFrame:
    """One row a mode of outer folds: medians, means, extremes and 5 and 95 per cent quantiles of their skill.

    Columns that begin with lowpass_ or spectral_ have a median and quantiles, those that begin with raw_
    or core_ a median; the early and the late fold stand apart too. Folds without skill count as folds only.
    """
    agg = [F.count(F.lit(1)).alias("fold_count"), F.count("r").alias("completed_count")]
    low, high = (lambda c, q=q: F.percentile(c, F.lit(q)) for q in (0.05, 0.95))
    for c in folds.columns:
        base = c.split("_", 1)[1] if c.startswith(("raw_", "core_")) else c
        scaled = base.startswith(("lowpass_", "spectral_"))
        if base not in FOLD_METRICS and not scaled:
            continue
        agg.append(F.median(c).alias(f"median_{c}"))
        if base == c:
            agg += [low(c).alias(f"q05_{c}"), high(c).alias(f"q95_{c}")]
            if not scaled:
                agg += [F.avg(c).alias(f"mean_{c}"), F.min(c).alias(f"minimum_{c}"), F.max(c).alias(f"maximum_{c}")]
    agg += [F.median(F.when(F.col("holdout_position") == side, F.col(c))).alias(f"{side}_holdout_{c}") for side in ("early", "late") for c in EDGE_METRICS if c in folds.columns]
    got = folds.groupBy(*keys).agg(*agg)
    told = {"validation_role": "sensitivity_only", "assessment_metric": "correlation", "ce_re_role": "reported_not_used_for_external_judgment"}
    return got.select(*keys, *[F.lit(v).alias(k) for k, v in told.items()], *[c for c in got.columns if c not in keys])


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, r, rmse, bias, sd_ratio, largest) of two reconstructions on their common years."""
    x, y = F.col("x"), F.col("y")
    rows = a.select("year", F.col("value").alias("x")).join(b.select("year", F.col("value").alias("y")), "year").dropna()
    return rows.agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias("r"), F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"), F.avg(x - y).alias("bias"), F.try_divide(F.stddev_samp(x), F.stddev_samp(y)).alias("sd_ratio"), F.max(F.abs(x - y)).alias("largest"))


def combine_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """(year, value): a's value, else b's."""
    rows = a.select("year", F.col("value").alias("x")).join(b.select("year", F.col("value").alias("y")), "year", "full")
    return rows.select("year", F.coalesce("x", "y").alias("value"))
