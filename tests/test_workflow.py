"""The workflow from a source table to written tables."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.config import FilterConfig, MultiresolutionConfig, PipelineConfig, ReconstructionConfig, ScreeningConfig, SensitivityConfig, TargetConfig, having
from varve.plans.pipeline import audit_violations, paired_difference, prepare_target, primary_summary, run_pipeline
from varve.operators.nests import within_replicates
from varve.operators import validation
from varve.plans.outer import FULL, RESCREENED, external_validation
from varve.plans.reconstruct import outer_validation, reconstruct, tune_slow_layer
from varve.sources import sinks
from varve.streaming.windows import merged_means, streaming_window_means


@pytest.fixture(scope="module")
def world(spark):
    """Ten noisy annual series, a coarse one and a copy of one, and their common signal observed late."""
    rng = np.random.default_rng(3)
    years = np.arange(1800, 2001)
    signal = np.convolve(rng.normal(size=205), np.ones(5) / 2, "valid")[:201]
    rows = []
    for k in range(10):
        start = 0 if k < 6 else 60
        noise = rng.normal(scale=0.6, size=201)
        rows.append((f"s{k}", [float(y) for y in years[start:]], [float(v) for v in (signal + noise)[start:]], "Wood" if k % 2 else "Coral", "http://x" if k == 1 else None))
    rows.append(("slow", [float(y) + 1 for y in years[::3]], [float(signal[i : i + 3].mean()) for i in range(0, 201, 3)], "Ice", None))
    rows.append(("s0copy", *rows[0][1:4], "http://y"))
    source = spark.createDataFrame(rows, "datasetId string, year array<double>, paleoData_values array<double>, archiveType string, originalDataURL string")
    observed = spark.createDataFrame([(int(y), float(v)) for y, v in zip(years, signal) if y >= 1900], "Year int, value double")
    return source, observed, dict(zip(years.tolist(), signal.tolist()))


CONFIG = PipelineConfig(reconstruction=having(ReconstructionConfig(), {"ensemble.members": 40, "nest.span": 50}), sensitivity=SensitivityConfig(delete_repeats=1, split_periods=(((1900, 1950), (1951, 2000)),)))


def test_whole_workflow(spark, world, tmp_path):
    source, observed, signal = world
    result = run_pipeline(source, observed, CONFIG)
    assert {r.pid for r in result.dropped.collect()} == {"s0"}
    roles = {r.pid: r.reconstruction_role for r in result.screening.collect()}
    assert roles["slow"] == "window" and roles["s1"] == "annual"
    series = result.reconstruction.series.orderBy("year").collect()
    got = np.array([r.point for r in series])
    truth = np.array([signal[r.year] for r in series])
    early = np.array([r.year < 1900 for r in series])
    assert early.sum() > 50 and np.corrcoef(got[early], truth[early])[0, 1] > 0.8
    assert all(r.q05 <= r.median <= r.q95 and r.ensemble_n >= 40 for r in series)
    assert result.reconstruction.layers.where("accepted").count() >= 1
    assert audit_violations(result).count() == 0
    assert {r.run.split(":")[0] for r in result.sensitivity.select("run").distinct().collect()} == {"deletion", "split"}
    skill = {r.metric: r.value for r in result.observation_fit.collect()}
    assert skill["r"] > 0.8 and skill["n"] == 101
    assert primary_summary(result).first().accepted_nests >= 1
    manifest = sinks.save(result, str(tmp_path / "out"))
    assert manifest["tables"]["reconstruction"] == len(series)
    assert spark.read.option("header", True).csv(str(tmp_path / "out/nest_summary")).count() == manifest["tables"]["nest_summary"]
    assert json.loads(spark.read.text(str(tmp_path / "out/manifest")).first()[0])["config"]["reconstruction"]["n_bootstrap"] == 40


def inputs(spark, world):
    source, observed, _ = world
    from varve.operators import temporal
    from varve.sources.series import load_series

    read = load_series(source.where("datasetId != 's0copy'"))
    records = read.records.join(temporal.native_resolution(read.observations), "pid")
    return read.observations, records, records.select("pid", F.lit("").alias("season")), observed.select(F.col("Year").alias("year"), F.col("value").alias("y"))


def test_variants_agree_with_themselves(spark, world):
    args = inputs(spark, world)
    cfg = having(ReconstructionConfig(), {"ensemble.members": 20})
    one, two = (reconstruct(*args, cfg=cfg).series for _ in range(2))
    value = lambda df: df.select("year", F.col("median").alias("value"))
    assert paired_difference(value(one), value(two)).first().equal
    blocks = reconstruct(*args, cfg=having(ReconstructionConfig(), {"ensemble.members": 10, "ensemble.scheme": "moving_block", "nest.combination": "densest"})).series
    assert blocks.where("ensemble_n = 10").count() > 0
    table = args[0].sparkSession.createDataFrame([("m", "a", 1900, [1.0, 5.0, None], 3, 1, 9), ("m", "b", 1900, [3.0, float("nan"), None], 2, 1, 9), ("m", "c", 1900, [8.0, 7.0, 2.0], 1, 1, 9)], "run string, nest_id string, year int, runs array<double>, core_count int, start int, end int")
    of = lambda how: sorted(within_replicates(table, how, ["run"]).first().runs)
    assert of("median") == [2.0, 3.0, 6.0] and of("densest") == [1.0, 2.0, 5.0]
    single = reconstruct(*args, cfg=having(ReconstructionConfig(), {"method": "native_missing", "ensemble.members": 0, "nest.subnests": False})).series
    assert single.count() > 100


def test_hopeless_target_is_rejected_not_tuned(spark, world):
    obs, records, selected, target = inputs(spark, world)
    noise = target.withColumn("y", F.sin(F.col("year") * 12.9898) * 43758.5453 % 1)
    got = reconstruct(obs, records, selected, noise, cfg=having(ReconstructionConfig(), {"ensemble.members": 10}))
    assert got.series.count() == 0 and {r.reason for r in got.nests.collect()} <= {"internal_ce_re", "insufficient_calibration"}
    assert got.nests.count() > 0


def test_outer_folds_and_slow_layer(spark, world):
    obs, records, selected, target = inputs(spark, world)
    cfg = having(ReconstructionConfig(), {"ensemble.members": 0})
    for rescreen in (False, True):
        got = {(r.run, r.metric): r.value for r in outer_validation(obs, records, selected, target, cfg=cfg, rescreen=rescreen).collect()}
        assert {k for k, _ in got} == {"early", "late"} and got["early", "r"] > 0.7 and got["late", "n"] == 34
    slow = MultiresolutionConfig(enabled=True, weight_candidates=(1.0, 10.0), period_candidates=(10.0,))
    few = records.withColumn("resolution", F.when(F.col("pid") == "slow", 11.0).otherwise(F.col("resolution")))
    tuned, grid = tune_slow_layer(obs, few, selected, target, cfg=having(ReconstructionConfig(), {"ensemble.members": 0, "multiresolution": slow}))
    table = {r.weight: r.objective for r in grid.collect()}
    assert set(table) == {0.0, 1.0, 10.0} and not tuned.multiresolution.auto_tune
    assert table[tuned.multiresolution.constraint_weight] == max(table.values())
    # what slow series and their samples say, and the grid, are tables of the reconstruction
    made = reconstruct(obs, few, selected, target, cfg=having(ReconstructionConfig(), {"ensemble.members": 0, "multiresolution": MultiresolutionConfig(enabled=True, auto_tune=False, constraint_weight=5.0)}))
    used = made.constraints.where("status = 'used'").collect()
    assert used and {r.pid for r in used} == {"slow"} and made.slow_selection is None
    rows = made.observations.groupBy("nest_id").count().collect()
    assert {r.nest_id: r["count"] for r in rows} == {r.nest_id: r.constraint_count for r in used}
    tuned_run = reconstruct(obs, few, selected, target, cfg=having(ReconstructionConfig(), {"ensemble.members": 0, "multiresolution": slow}))
    assert {r.weight for r in tuned_run.slow_selection.where("selected").collect()} == {tuned.multiresolution.constraint_weight}


def test_target_and_empty_selection(spark, world):
    obs, records, selected, _ = inputs(spark, world)
    years = spark.createDataFrame([(1900 + k, float(k) + math.sin(k)) for k in range(60)], "Year int, v double")
    flat = prepare_target(years, TargetConfig(detrend=True))
    assert abs(flat.agg(F.avg("y")).first()[0]) < 1e-9
    assert prepare_target(years, TargetConfig(lowpass_years=10)).count() == 60
    with pytest.raises(ValueError, match="no series"):
        reconstruct(obs, records, selected.limit(0), flat)
    assert FilterConfig().maximum_plausible_year == 2100


def test_stream_of_samples(spark, tmp_path):
    rows = [("a", 1900.0 + k, float(k), f"2024-01-01 00:{k:02d}:00") for k in range(20)]
    df = spark.createDataFrame(rows, "pid string, time double, value double, arrived string").withColumn("arrived", F.to_timestamp("arrived"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming_window_means(stream, 1900, 5).writeStream.format("memory").queryName("parts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.window_id: r.value for r in merged_means(spark.table("parts")).collect()}
    assert got == {1900: 2.0, 1905: 7.0, 1910: 12.0, 1915: 17.0}


def test_external_validation_in_both_modes(spark, world):
    obs, records, selected, target = inputs(spark, world)
    cfg = having(ReconstructionConfig(), {"ensemble.members": 0, "evaluation.outer_folds": "blocks", "standardization_period": (1900, 2000)})
    folds = external_validation(obs, records, selected, target, cfg=cfg, modes=[FULL, RESCREENED])
    rows = folds.collect()
    assert [(r.validation_mode, r.fold, r.holdout_position, r.held_years, r.train_years) for r in rows] == [(m, k, p, n, 101 - n) for m in (FULL, RESCREENED) for k, p, n in ((1, "early", 34), (2, "middle", 34), (3, "late", 33))]
    assert all(r.fit_status == "completed" and r.fit_error is None and r.n == r.held_years and r.r > 0.6 and r.accepted_nest_count > 0 for r in rows)
    assert {r.selected_proxy_count for r in rows if r.validation_mode == FULL} == {selected.count()}
    summary = {r.validation_mode: r for r in validation.summarize_modes(folds).collect()}
    own = sorted(r.r for r in rows if r.validation_mode == FULL)
    assert summary[FULL].median_r == pytest.approx(own[1]) and summary[FULL].minimum_r == pytest.approx(own[0]) and summary[FULL].fold_count == 3
    assert summary[FULL].early_holdout_ce == pytest.approx(rows[0].ce) and "median_lowpass_10y_r" in summary[FULL].asDict() and "median_raw_r" in summary[FULL].asDict()


def test_held_out_years_are_never_seen(spark, world):
    """Other values in a fold's held-out years change neither its reconstruction nor its selection, only its skill."""
    obs, records, selected, target = inputs(spark, world)
    cfg = having(ReconstructionConfig(), {"ensemble.members": 0, "standardization_period": (1900, 2000)})
    late = F.col("year") > 2000 - 34
    other = target.withColumn("y", F.when(late, -F.col("y") * 3 + 1).otherwise(F.col("y")))
    a, b = (external_validation(obs, records, selected, t, cfg=cfg, modes=[RESCREENED]).where("fold = 2").first() for t in (target, other))
    assert a.validation_start == 1967 and a.predicted_sd == pytest.approx(b.predicted_sd, abs=1e-12) and a.selected_proxy_count == b.selected_proxy_count
    assert a.observed_sd != pytest.approx(b.observed_sd)


def test_folds_that_fail_are_rows(spark, world):
    obs, records, selected, target = inputs(spark, world)
    cfg = having(ReconstructionConfig(), {"ensemble.members": 0})
    noise = F.sin(F.col("year") * 12.9898) * 43758.5453 % 1
    # without the early part there is nothing to learn but noise, so that no series is selected then
    half = target.withColumn("y", F.when(F.col("year") > 1900 + 33, noise).otherwise(F.col("y")))
    strict = ScreeningConfig(r_threshold=0.5)
    rows = {r.fold: r for r in external_validation(obs, records, selected, half, cfg=cfg, scr=strict, modes=[RESCREENED]).collect()}
    assert set(rows) == {1, 2} and rows[1].fit_status == "unavailable" and rows[1].fit_error == "no series is selected"
    assert rows[1].n == 0 and rows[1].r is None and rows[1].held_years == 34 and rows[1].train_years == 67 and rows[1].validation_start == 1900
    hopeless = having(cfg, {"gates.ce": 0.999, "gates.re": 0.999})
    failed = external_validation(obs, records, selected, target, cfg=hopeless, modes=[FULL]).collect()
    assert [r.fit_status for r in failed] == ["unavailable"] * 2 and all(r.fit_error.startswith("no nest was accepted: ") and r.candidate_nest_count > 0 for r in failed)
    short = external_validation(obs, records, selected, target.where("year < 1915"), cfg=cfg, modes=[FULL])
    assert short.count() == 0 and "fit_status" in short.columns
    summary = validation.summarize_modes(spark.createDataFrame(failed, external_validation(obs, records, selected, target.where("year < 1915"), cfg=cfg).schema)).first()
    assert summary.fold_count == 2 and summary.completed_count == 0 and summary.median_r is None


def test_external_tables_are_written(spark, world, tmp_path):
    source, observed, _ = world
    result = run_pipeline(source, observed, having(CONFIG, {"reconstruction.ensemble.members": 0, "reconstruction.evaluation.outer": True, "reconstruction.evaluation.rescreen": True, "output.show_external": True, "sensitivity": SensitivityConfig()}))
    sinks.save(result, str(tmp_path / "out"))
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / "out" / name))
    assert {(r.validation_mode, r.fold) for r in read("validation_folds").collect()} == {(m, str(k)) for m in (FULL, RESCREENED) for k in (1, 2)}
    assert read("validation_by_mode").where(F.col("validation_mode") == FULL).count() == 2
    assert {r.validation_mode for r in read("validation_summary").collect()} == {FULL, RESCREENED}
