"""The whole workflow: read, deduplicate, filter, target, screen, reconstruct, validate."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig, TargetConfig
from ..functions.storage import kept
from ..kernels.smooth import butterworth
from ..operators import dedup, filters, screening, temporal, validation
from ..sources import series as sources
from .outer import FULL, RESCREENED, external_validation
from .reconstruct import Reconstruction, reconstruct, score_runs, sensitivities, target_years


@dataclass
class PipelineResult:
    config: PipelineConfig
    records: DataFrame
    decisions: DataFrame
    rejects: DataFrame
    dropped: DataFrame | None
    duplicate_groups: DataFrame | None
    target: DataFrame
    screening: DataFrame
    reconstruction: Reconstruction
    observation_fit: DataFrame
    validation_folds: DataFrame | None = None
    validation_summary: DataFrame | None = None
    sensitivity: DataFrame | None = None
    summary: dict = field(default_factory=dict)


def prepare_target(source: DataFrame, cfg: TargetConfig = TargetConfig()) -> DataFrame:
    """(year, y): annual or seasonal means, detrended and low-pass filtered if asked. A target is one short series."""
    t = sources.load_observations(source, cfg.year_column, cfg.value_column, cfg.months, cfg.anchor, cfg.month_fraction)
    if cfg.detrend:
        t = temporal.linear_detrend(t.select(F.lit("t").alias("pid"), "year", F.col("y").alias("value")).dropna()).select("year", F.col("value").alias("y"))
    if cfg.lowpass_years:
        period, order = cfg.lowpass_years, cfg.lowpass_order

        def smooth(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("year")
            return pd.DataFrame({"year": g["year"], "y": butterworth(g["y"].to_numpy(dtype=float), period, order)})

        t = t.where("y is not null").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(smooth, "year int, y double")
    return t


def _source_facts(df: DataFrame) -> DataFrame:
    """What deduplication compares: pid, seq, quality, has_url, kind and place."""
    text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit("")
    place = lambda c: F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
    url = F.col("originalDataURL").isNotNull() if "originalDataURL" in df.columns else F.lit(False)
    return df.select(
        F.trim(F.col("datasetId").cast("string")).alias("pid"), F.monotonically_increasing_id().alias("seq"), dedup.completeness(df, ("year", "paleoData_values")).alias("quality"), url.alias("has_url"),
        text("archiveType").alias("archive"), text("paleoData_proxy").alias("proxy"), text("paleoData_variableName").alias("variable"), place("geo_meanLat").alias("lat"), place("geo_meanLon").alias("lon"),
    )


def run_pipeline(source: DataFrame, observations: DataFrame, config: PipelineConfig = PipelineConfig()) -> PipelineResult:
    read = sources.load_series(source)
    obs, records = kept(read.observations), read.records
    dropped = groups = None
    if config.filter.deduplicate_exact and "datasetId" in source.columns:
        left, dropped, groups = dedup.deduplicate(kept(_source_facts(source)), obs, config.filter.deduplicate_near)
        records = records.join(left.select("pid"), "pid", "left_semi")
    facts = kept(records.join(temporal.record_metadata(obs), "pid"))
    decisions = filters.filter_decisions(facts, config.filter)
    records = kept(decisions.where("included").drop("reasons", "included"))
    target = kept(prepare_target(observations, config.target))
    table = kept(screening.screen(obs, records, target, config.screening))
    cfg = config.reconstruction
    table = table.withColumn("reconstruction_role", F.when(F.col("selected"), filters.reconstruction_role(F.col("resolution"), cfg.nest, cfg.multiresolution.enabled)).otherwise("not_selected"))
    selected = table.where("selected").select("pid", F.coalesce("season", F.lit("")).alias("season"))
    made = reconstruct(obs, records, selected, target, config.pca, cfg, config.screening)
    values = target_years(target)
    years = list(values)
    fit = score_runs(made.series, values, {"main": years}, {"main": years}, cfg)
    modes = [FULL] * cfg.evaluation.outer + [RESCREENED] * cfg.evaluation.rescreen
    folds = external_validation(obs, records, selected, target, config.pca, cfg, config.screening, modes) if modes else None
    sens = config.sensitivity
    more = sensitivities(obs, records, selected, target, config) if sens.single or sens.leave_one_out or sens.delete_repeats or sens.split_periods else None
    return PipelineResult(config, facts, decisions, read.rejects, dropped, groups, target, table, made, fit, folds, None if folds is None else validation.summarize_modes(folds), more)


def primary_summary(result: PipelineResult) -> DataFrame:
    """One row about the reconstruction: nests, gates, span, medians of skill."""
    nests = result.reconstruction.nests
    one = nests.agg(F.count(F.lit(1)).alias("candidate_nests"), F.sum(F.col("accepted").cast("int")).alias("accepted_nests"), F.median(F.when(F.col("accepted"), F.col("median_ce"))).alias("median_ce"), F.median(F.when(F.col("accepted"), F.col("median_re"))).alias("median_re"))
    span = result.reconstruction.series.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max("ensemble_n").alias("most_members"))
    return one.crossJoin(span)


def audit_violations(result: PipelineResult) -> DataFrame:
    """(check, n): rules that outputs must keep; no rows if all do."""
    made = result.reconstruction
    cfg = result.config.reconstruction
    nets = made.nests.groupBy("run", "pids").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    gate = made.nests.where("accepted").where(~filters.passes_gate(F.col("median_ce"), F.col("median_re"), cfg.gates.floor if cfg.gates.ce is None else cfg.gates.ce, cfg.gates.floor if cfg.gates.re is None else cfg.gates.re, cfg.gates.comparison))
    run = made.series.groupBy("run").agg((F.max("year") - F.min("year") + 1 - F.count(F.lit(1))).alias("k")).where("k != 0")
    filled = made.annual.where("is_native and is_interpolated")
    checks = [("networks_repeat", nets), ("gate_not_passed", gate if cfg.nest.require_gate and cfg.auto_tune else gate.limit(0)), ("series_broken", run if cfg.gaps.longest_only else run.limit(0)), ("native_and_interpolated", filled)]
    out = None
    for name, bad in checks:
        part = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n").where("n > 0")
        out = part if out is None else out.unionByName(part)
    return out


def paired_difference(a: DataFrame, b: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Rows of ``validation.compare`` with a verdict on equality."""
    return validation.compare(a, b).withColumn("equal", F.coalesce(F.col("largest") <= tolerance, F.lit(False)))


