"""External validation: outer folds that nothing has seen, one row a fold whatever becomes of it.

Outer folds are the early and the late part of the calibration years, or contiguous blocks of them. Two
modes: ``full_proxy_network`` keeps the selected series; ``rescreened_network`` selects them anew, with
their seasons, from each fold's training years. Scaling, bases, regressions, inner folds, gates and the
tuning of slow layers see training years only, in both modes.

All folds of all modes are runs of one plan: series are copied under the run's name, so each run has its own
seasons and scales, and the nests of all runs are fitted together (run, nest), each with the inner folds of
its run's training years. Runs whose slow layers are tuned differently go in one plan for each setting.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PCAConfig, ReconstructionConfig, ScreeningConfig, having
from ..functions.storage import kept
from ..operators.filters import calibration_years
from ..operators.screening import screen
from ..operators.validation import contiguous_folds, edge_folds, outer_fold_table
from .reconstruct import Reconstruction, reconstruct, score_names, score_runs, tune_slow_layer

FULL, RESCREENED = "full_proxy_network", "rescreened_network"


def outer_folds(years: DataFrame, pca: PCAConfig, cfg: ReconstructionConfig) -> DataFrame:
    """(fold, year): held-out years; folds count from 1."""
    least = max(20, pca.max_components + 3)
    ev = cfg.evaluation
    rows = edge_folds(years, ev.external_fraction, least_train=least) if ev.outer_folds == "edges" else contiguous_folds(years, ev.block_years, least_train=least)
    return rows.select((F.col("fold") + 1).alias("fold"), "year")


def _selections(obs: DataFrame, records: DataFrame, selected: DataFrame, target: DataFrame, learn: DataFrame, runs: list[tuple[str, str, int]], scr: ScreeningConfig) -> DataFrame:
    """(run, pid, season) of all runs; learn has (fold, year). Rescreening is one branch a fold, and folds are few."""
    parts = []
    for run, mode, fold in runs:
        own = selected
        if mode == RESCREENED:
            seen = target.join(learn.where(F.col("fold") == fold).select("year"), "year", "left_semi")
            own = screen(obs, records, seen, replace(scr, period=None)).where("selected")
        parts.append(own.select(F.lit(run).alias("run"), "pid", F.coalesce("season", F.lit("")).alias("season")))
    return kept(reduce(DataFrame.unionByName, parts))


def _fitted(obs, records, own: DataFrame, target, train: dict[str, Sequence[int]], pca, cfg, scr) -> list[Reconstruction]:
    """Reconstructions of all runs of own (run, pid, season), with series named run:pid inside."""
    spark = obs.sparkSession
    name = F.concat_ws(":", "run", "pid")
    copy = lambda df: df.join(own.select("run", "pid"), "pid").withColumn("pid", name).drop("run")
    years = spark.createDataFrame([(r, y) for r, many in train.items() for y in many], "run string, year int")
    settings: dict[ReconstructionConfig, list[str]] = {}
    for run, many in train.items():
        best = cfg
        if cfg.multiresolution.enabled and cfg.multiresolution.auto_tune:
            # a tuned layer learns from the run's training years alone
            seen = target.join(years.where(F.col("run") == run).select("year"), "year", "left_semi")
            mine = own.where(F.col("run") == run)
            best, _ = tune_slow_layer(obs, records, mine.select("pid", "season"), seen, pca, cfg, scr)
        settings.setdefault(best, []).append(run)
    out = []
    for best, some in settings.items():
        mine = own.where(F.col("run").isin(some))
        part = lambda df: copy(df).join(mine.select(name.alias("pid")), "pid", "left_semi")  # noqa: E731, B023
        scale = mine.join(years, "run").select(name.alias("pid"), "year") if best.standardization_period else None
        out.append(reconstruct(part(obs), part(records), mine.select(name.alias("pid"), "season"), target, pca, best, scr, mine.select("run", name.alias("pid")), {r: train[r] for r in some}, scale))
    return out


def external_validation(obs, records, selected, target, pca: PCAConfig = PCAConfig(), cfg: ReconstructionConfig = ReconstructionConfig(), scr: ScreeningConfig = ScreeningConfig(), modes: Sequence[str] = (FULL,)) -> DataFrame:
    """One row a mode and fold: status, years, sizes, and skill on the held-out years at all scales.

    A fold without selected series, without an accepted nest, or without a reconstructed held-out year has
    the status ``unavailable``, its reason, n of 0 and no skill; the others are not disturbed.
    """
    spark = obs.sparkSession
    years = calibration_years(target, cfg.calibration_period)
    held_rows = kept(outer_folds(years, pca, cfg))
    table = kept(outer_fold_table(years, held_rows))
    facts = table.orderBy("fold").collect()  # a few folds over the target's years
    held_years: dict[int, list[int]] = {}
    for r in held_rows.orderBy("fold", "year").collect():
        held_years.setdefault(r["fold"], []).append(r["year"])
    every = [r["year"] for r in years.select("year").distinct().orderBy("year").collect()]
    values = {r["year"]: r["y"] for r in years.collect()}
    runs = [(f"{mode}|{r['fold']}", mode, r["fold"]) for mode in modes for r in facts]
    held = {run: held_years[fold] for run, _, fold in runs}
    train = {run: sorted(set(every) - set(held[run])) for run in held}
    rows = spark.createDataFrame(runs, "run string, validation_mode string, fold int").join(table, "fold")
    names = score_names(cfg)
    inner = having(cfg, {"ensemble.members": 0 if cfg.method == "explicit_nest" else cfg.ensemble.members, "gaps.longest_only": False})
    learn = spark.createDataFrame([(r["fold"], y) for r in facts for y in every if y not in set(held_years[r["fold"]])], "fold int, year int")
    got: list[Reconstruction] = []
    own = None
    if runs:
        own = _selections(obs, records, selected, target, learn, runs, scr)
        some = {r["run"] for r in own.select("run").distinct().collect()}
        got = _fitted(obs, records, own, target, {r: train[r] for r in train if r in some}, pca, inner, scr) if some else []
    if got:
        series, nests = (reduce(DataFrame.unionByName, many) for many in ([g.series for g in got], [g.nests for g in got]))
        scores = kept(score_runs(series, values, held, train, cfg)).groupBy("run").pivot("metric", names).agg(F.first("value"))
        counts = nests.groupBy("run").agg(F.count(F.lit(1)).alias("candidate_nest_count"), F.count_if("accepted").alias("accepted_nest_count"), F.mode(F.when(~F.col("accepted"), F.col("reason")), True).alias("reason"))
        rows = rows.join(scores, "run", "left").join(counts, "run", "left").join(own.groupBy("run").agg(F.count(F.lit(1)).alias("selected_proxy_count")), "run", "left")
    else:
        none = {n: F.lit(None).cast("double") for n in names} | {n: F.lit(None).cast("long") for n in ("candidate_nest_count", "accepted_nest_count", "selected_proxy_count")}
        rows = rows.withColumns(none | {"reason": F.lit(None).cast("string")})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "candidate_nest_count", "accepted_nest_count", "selected_proxy_count")})
    why = F.when(F.col("selected_proxy_count") == 0, "no series is selected").when(F.col("candidate_nest_count") == 0, "no nest has series enough").when(F.col("accepted_nest_count") == 0, F.concat_ws(": ", F.lit("no nest was accepted"), "reason")).otherwise("no held-out year is reconstructed")
    done = F.col("n") > 0
    return kept(rows.select(
        F.when(done, "completed").otherwise("unavailable").alias("fit_status"), F.when(~done, why).alias("fit_error"), F.lit("sensitivity_only").alias("validation_role"), "validation_mode", F.lit("correlation").alias("assessment_metric"),
        "fold", "validation_start", "validation_end", "holdout_position", "held_years", "train_years", (F.col("validation_mode") == RESCREENED).alias("screening_refit"), "selected_proxy_count", "candidate_nest_count", "accepted_nest_count", *[F.col(n) for n in names],
    ).orderBy("validation_mode", "fold"))
