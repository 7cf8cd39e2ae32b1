"""Reconstruction of a target from series by nested component regressions, as one distributed plan.

Relational steps select, annualize, enumerate nests and gather each nest's rows; one grouped function
fits a nest and returns tagged rows (members, points, audits) that are written once and then split.
Folds, networks and runs of sensitivity experiments are a key in front of the nest (``run``), so all of
them spread over the cluster together.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PCAConfig, PipelineConfig, ReconstructionConfig, ScreeningConfig, having
from ..functions.stats import number
from ..functions.storage import kept
from ..kernels import model as models
from ..kernels import skill as skills
from ..kernels.nest_weights import nest_weights
from ..kernels.smooth import assimilate, lowpass
from ..operators import nests as nest_ops
from ..operators import temporal
from ..operators.screening import screen
from ..operators.validation import edge_folds

TAGGED = "run string, nest_id string, kind string, year int, value double, raw double, runs array<double>, core_count int, start int, end int, payload string"


@dataclass
class Reconstruction:
    series: DataFrame
    nests: DataFrame
    selection: DataFrame
    layers: DataFrame
    weights: DataFrame
    availability: DataFrame
    members: DataFrame
    annual: DataFrame
    constraints: DataFrame
    observations: DataFrame
    slow_selection: DataFrame | None = None


def selected_annual(obs: DataFrame, selected: DataFrame, scr: ScreeningConfig) -> DataFrame:
    """(pid, year, value) of the selected series, each annualized over its own season. selected: pid, season (months joined by commas)."""
    resolution = temporal.native_resolution(obs)
    out = None
    for (season,) in selected.select("season").distinct().collect():
        months = tuple(int(m) for m in season.split(",")) if season else scr.months
        rows = obs.join(selected.where(F.col("season").eqNullSafe(season)).select("pid"), "pid", "left_semi")
        part = temporal.annualize(rows, months, scr.anchor, scr.month_fraction, resolution)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no series is selected")
    return out


def prepared_matrix(annual: DataFrame, records: DataFrame, cfg: ReconstructionConfig, train: DataFrame | None = None) -> DataFrame:
    """(pid, year, value, is_native, is_interpolated): the matrix with its short gaps filled and, if asked, scaled over the reference period."""
    bounds = annual.groupBy("pid").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    grid = bounds.select("pid", F.explode(F.sequence("a", "b")).alias("year"))
    dense = grid.join(annual, ["pid", "year"], "left")
    if cfg.gaps.fill == "none":
        filled = dense.withColumns({"is_native": F.col("value").isNotNull(), "is_interpolated": F.lit(False)})
    else:
        facts = records.select("pid", F.coalesce(F.lower(F.trim("archive")).isin(*[a.strip().lower() for a in cfg.gaps.archives]) & (F.col("resolution") <= cfg.gaps.coarsest), F.lit(False)).alias("fits"))
        filled = temporal.fill_short_gaps(dense.join(facts, "pid"), cfg.gaps.most_years, F.col("fits")).drop("fits")
    if cfg.standardization_period:
        z = temporal.reference_zscore(filled.select("pid", "year", "value"), *cfg.standardization_period, train)
        filled = filled.drop("value").join(z.select("pid", "year", "value"), ["pid", "year"])
    return filled


def core_limit(cfg: ReconstructionConfig) -> float:
    """The coarsest resolution of series in the annual matrix."""
    if cfg.nest.subnests:
        return cfg.nest.direct_resolution
    return cfg.multiresolution.regression_max_resolution if cfg.multiresolution.enabled else float("inf")


def _nest_rows(runs: DataFrame, matrix: DataFrame, obs: DataFrame, records: DataFrame, cfg: ReconstructionConfig) -> DataFrame:
    """(run, nest_id, start, end, kind, pid, x, y, facts): matrix cells, native samples and facts of every nest's series."""
    member = runs.select("run", "nest_id", "start", "end", F.explode("pids").alias("pid"))
    fine = F.coalesce(F.col("resolution") <= core_limit(cfg), F.lit(True))
    error = [F.when(number(F.element_at("metadata", F.lit(f))) > 0, number(F.element_at("metadata", F.lit(f)))) for f in cfg.weights.error_fields]
    facts = records.select("pid", fine.alias("core"), F.to_json(F.struct("archive", "proxy", "lat", "lon", "resolution", F.element_at("metadata", F.lit("geo_siteName")).alias("site"), F.element_at("metadata", F.lit("dataSetName")).alias("source"), F.coalesce(*error).alias("error_sd"))).alias("facts"))
    member = member.join(facts, "pid")
    none = F.lit(None).cast("string")
    cells = member.where("core").join(matrix.where("value is not null").select("pid", F.col("year").cast("double").alias("x"), F.col("value").alias("y")), "pid").where(F.col("x").between(F.col("start"), F.col("end")))
    native = member.where("not core").join(obs.select("pid", F.col("time").alias("x"), F.col("value").alias("y")), "pid")
    heads = member.withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")})
    one = lambda df, kind, f: df.select("run", "nest_id", "start", "end", F.lit(kind).alias("kind"), "pid", "x", "y", f.alias("facts"))
    return one(heads, "fact", F.col("facts")).unionByName(one(cells, "cell", none)).unionByName(one(native, "native", none))


def _clean(x):
    if isinstance(x, dict):
        return {k: _clean(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_clean(v) for v in x]
    if isinstance(x, np.generic):
        x = x.item()
    return None if isinstance(x, float) and not np.isfinite(x) else x


def fit_nests(runs: DataFrame, matrix: DataFrame, obs: DataFrame, records: DataFrame, target: dict[int, float], train: dict[str, Sequence[int]], pca: PCAConfig, cfg: ReconstructionConfig) -> DataFrame:
    """Tagged rows of all nests of all runs. target has one value a year and train the years each run may learn from: both are short by nature."""
    ty = np.array(sorted(target))
    tv = np.array([target[t] for t in ty])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[0]
        start, end = int(head["start"]), int(head["end"])
        years = np.arange(start, end + 1)
        facts = {p: json.loads(f) for p, f in group.loc[group["kind"] == "fact", ["pid", "facts"]].itertuples(index=False)}
        cells = group[group["kind"] == "cell"]
        names = sorted(p for p, f in facts.items() if (f.get("resolution") or 0) <= core_limit(cfg))
        place = {p: k for k, p in enumerate(names)}
        x = np.full((len(years), len(names)), np.nan)
        x[cells["x"].to_numpy(dtype=int) - start, cells["pid"].map(place).to_numpy(dtype=int)] = cells["y"].to_numpy(dtype=float)
        native = {p: (g["x"].to_numpy(dtype=float), g["y"].to_numpy(dtype=float), facts[p].get("resolution") or np.nan) for p, g in group[group["kind"] == "native"].sort_values("x").groupby("pid")}
        y = np.full(len(years), np.nan)
        inside = (ty >= start) & (ty <= end)
        y[ty[inside] - start] = tv[inside]
        learn = np.array(sorted(train[head["run"]]))
        weigh = (lambda fit_rows, columns: nest_weights(fit_rows, [facts[names[c]] for c in columns if c < len(names)], cfg.weights)) if cfg.weights.enabled else None
        try:
            got = models.fit_nest(x, years, names, native, y, learn, pca, cfg, weigh)
        except (RuntimeError, ValueError, np.linalg.LinAlgError) as e:
            got = {"accepted": False, "reason": f"{type(e).__name__}: {e}", "layers": []}
        base = {"run": head["run"], "nest_id": head["nest_id"], "core_count": len(names), "start": start, "end": end}
        low = sorted(set(facts) - set(names))
        audit = {"accepted": got["accepted"], "reason": got["reason"], "span_years": end - start + 1, "pids": "|".join(sorted(facts)), "core_pids": "|".join(names), "low_pids": "|".join(low), "n_components": got.get("n_components"), "regression": got.get("regression"), "fusion": len(got.get("fusion", ()))}
        chosen = next((r for r in reversed(got.get("selection", [])) if r["selected"]), {})
        audit |= {k: chosen.get(k) for k in ("median_ce", "median_re", "median_r", "median_sd_ratio")}
        rows = [base | {"kind": "nest", "payload": json.dumps(_clean(audit))}]
        rows += [base | {"kind": kind, "payload": json.dumps(_clean(r))} for kind, many in (("selection", got.get("selection", [])), ("layer", got["layers"]), ("slow", got.get("slow", [])), ("slow_sample", got.get("slow_sample", []))) for r in many]
        rows += [base | {"kind": "weight", "payload": json.dumps({"pid": p, "weight": w})} for p, w in got.get("weights", {}).items()]
        if got["accepted"]:
            for k in np.flatnonzero(np.isfinite(got["point"])):
                m = got["members"]
                # replicates of moving blocks keep their places, as nests are combined within each
                runs_here = None if m is None else m[k] if cfg.ensemble.scheme == "moving_block" else m[k][np.isfinite(m[k])]
                rows.append(base | {"kind": "point", "year": int(years[k]), "value": float(got["point"][k]), "raw": float(got["raw"][k]) if np.isfinite(got["raw"][k]) else None, "runs": runs_here})
        names_out = [c.split()[0] for c in TAGGED.split(", ")]
        frame = pd.DataFrame(rows).reindex(columns=names_out)
        return frame.astype(object).where(frame.notna(), None) if len(frame) else frame

    # fitting costs seconds a nest and few bytes: as many partitions as nests, which are not coalesced by size
    parts = max(1, min(runs.count(), 10_000))
    rows = _nest_rows(runs, matrix, obs, records, cfg).repartition(parts, "run", "nest_id")
    return kept(rows.groupBy("run", "nest_id").applyInPandas(fit, TAGGED))


def combine(tagged: DataFrame, cfg: ReconstructionConfig, n_members: int) -> DataFrame:
    """(run, year, point, raw, quantiles, ensemble_n, nests): nests combined year by year, quantiles over all their members."""
    points = tagged.where("kind = 'point'")
    out = None
    for column in ("value", "raw"):
        rows = points.where(F.col(column).isNotNull())
        if cfg.nest.combination == "median":
            part = rows.groupBy("run", "year").agg(F.median(column).alias("point" if column == "value" else "point_raw"), F.count(F.lit(1)).alias("nests"))
        else:
            order = Window.partitionBy("run", "year").orderBy(F.desc("core_count"), "start", F.desc("end"), "nest_id")
            part = rows.withColumns({"place": F.row_number().over(order), "nests": F.count(F.lit(1)).over(Window.partitionBy("run", "year"))}).where("place = 1").select("run", "year", F.col(column).alias("point" if column == "value" else "point_raw"), "nests")
        out = part if out is None else out.join(part.drop("nests"), ["run", "year"], "left")
    if n_members:
        rows = points
        if cfg.nest.combination == "densest":
            order = Window.partitionBy("run", "year").orderBy(F.desc("core_count"), "start", F.desc("end"), "nest_id")
            rows = points.withColumn("place", F.row_number().over(order)).where("place = 1")
        if cfg.ensemble.scheme == "moving_block":
            rows = nest_ops.within_replicates(points, cfg.nest.combination, ["run"])
            good = rows.groupBy("run").agg(F.max(F.size(F.filter("runs", lambda v: v.isNotNull()))).alias("n"))
            short = good.where(F.col("n") < int(np.ceil(n_members * cfg.ensemble.success_fraction))).first()
            if short:
                raise RuntimeError(f"only {short['n']} of {n_members} replicates of {short['run']} succeeded")
        out = out.join(nest_ops.pool_members(rows, ["run"]), ["run", "year"], "left")
        out = out.withColumn("median_full_fit", F.col("point"))
    else:
        out = out.withColumns({q: F.col("point") for q in nest_ops.QUANTILES} | {"ensemble_n": F.col("nests"), "median_full_fit": F.col("point")})
    return out


def payloads(tagged: DataFrame, kind: str, schema: str) -> DataFrame:
    return tagged.where(F.col("kind") == kind).select("run", "nest_id", "start", "end", F.from_json("payload", schema).alias("p")).select("run", "nest_id", "start", "end", "p.*")


NEST_FACTS = "accepted boolean, reason string, span_years int, pids string, core_pids string, low_pids string, n_components int, regression string, fusion int, median_ce double, median_re double, median_r double, median_sd_ratio double"
SELECTION = "stage string, selected boolean, regression string, n_components int, alpha double, amplitude string, folds int, median_ce double, median_re double, minimum_ce double, minimum_re double, median_r double, median_rmse double, median_sd_ratio double, robust_skill double, passes boolean, objective double"
LAYERS = "resolution_years int, pids string, windows int, calibration_windows int, accepted boolean, reason string, n_components int, median_ce double, median_re double"

#: The columns of the audits of slow series and of their samples.
CONSTRAINTS = "pid string, status string, native_resolution double, minimum_support_years double, median_support_years double, maximum_support_years double, calibration_overlap int, constraint_count int, psm_intercept double, psm_slope double, psm_residual_variance double, lowpass_period_years double, increment_reference_scale double"
OBSERVATIONS = "pid string, native_time double, support_width_years double, support_start double, support_end double, annual_state_start int, annual_state_end int, annual_state_count int, proxy_value double, mapped_lowpass_value double, core_lowpass_window_mean double, innovation double, constraint_weight double"


def run_nests(annual: DataFrame, records: DataFrame, cfg: ReconstructionConfig, networks: DataFrame | None = None) -> DataFrame:
    """(run, nest_id, start, end, pids) of the coverage nests, of each network (run, pid) if given. One network in all for the native_missing method."""
    bounds = nest_ops.envelopes(annual)
    if not cfg.multiresolution.enabled:
        bounds = bounds.join(records.where(F.col("resolution").isNull() | (F.col("resolution") <= cfg.nest.subnest_max_resolution)).select("pid"), "pid", "left_semi")
    first, last = cfg.period or (None, None)
    if networks is None:
        networks = bounds.select(F.lit("main").alias("run"), "pid")
    if cfg.method == "native_missing":
        rows = networks.join(bounds, "pid").groupBy("run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("pid")).alias("pids"))
        clip = rows.withColumns({"start": F.greatest("start", F.lit(first)) if first is not None else F.col("start"), "end": F.least("end", F.lit(last)) if last is not None else F.col("end")})
        return clip.select("run", F.lit("all").alias("nest_id"), "start", "end", "pids")
    return nest_ops.coverage_nests(networks.join(bounds, "pid"), cfg.nest, first, last, ["run"])


def target_years(target: DataFrame) -> dict[int, float]:
    """The target as a dictionary: one value a year."""
    return {r["year"]: r["y"] for r in target.where("y is not null").collect()}


def reconstruct(obs: DataFrame, records: DataFrame, selected: DataFrame, target: DataFrame, pca: PCAConfig = PCAConfig(), cfg: ReconstructionConfig = ReconstructionConfig(), scr: ScreeningConfig = ScreeningConfig(), networks: DataFrame | None = None, train: dict[str, Sequence[int]] | None = None, scale_years: DataFrame | None = None) -> Reconstruction:
    """Reconstruct the target. records: pid, archive, proxy, lat, lon, metadata, resolution; selected: pid, season.

    ``train`` has the years that each run may learn from, ``scale_years`` (pid, year) those that a series may be scaled by.
    """
    grid = None
    if cfg.multiresolution.enabled and cfg.multiresolution.auto_tune:
        cfg, grid = tune_slow_layer(obs, records, selected, target, pca, cfg, scr)
        chosen = F.col("weight").eqNullSafe(cfg.multiresolution.constraint_weight)
        if cfg.multiresolution.constraint_weight > 0:
            chosen = chosen & F.col("period").eqNullSafe(cfg.multiresolution.lowpass_period)
        grid = grid.withColumn("selected", chosen)
    values = target_years(target)
    period = cfg.calibration_period
    years = sorted(t for t in values if period is None or period[0] <= t <= period[1])
    train = train or {}
    learn = scale_years
    if learn is None and cfg.standardization_period:
        learn = obs.sparkSession.createDataFrame([(y,) for y in years], "year int")
    obs = kept(obs.join(selected.select("pid"), "pid", "left_semi"))
    annual = kept(prepared_matrix(selected_annual(obs, selected, scr), records, cfg, learn))
    runs = kept(run_nests(annual.where("value is not null and is_native"), records, cfg, networks))
    names = [r["run"] for r in runs.select("run").distinct().collect()]
    tagged = fit_nests(runs, annual, obs, records, values, {n: train.get(n, years) for n in names}, pca, cfg)
    series = kept(combine(tagged, cfg, cfg.ensemble.members))
    if cfg.gaps.longest_only:
        best = temporal.longest_run(series.select("run", "year", F.col("point").alias("value")), ["run"])
        series = series.join(best.drop("years"), "run").where(F.col("year").between(F.col("start"), F.col("end"))).drop("start", "end")
    points = tagged.where("kind = 'point'")
    weights, constraints = payloads(tagged, "weight", "pid string, weight double"), payloads(tagged, "slow", CONSTRAINTS)
    nests = payloads(tagged, "nest", NEST_FACTS)
    support = points.groupBy("run", "year").agg(F.count(F.lit(1)).alias("contributing_nests"), F.max("core_count").alias("maximum_core_count"))
    member = runs.select("run", F.explode("pids").alias("pid")).distinct()
    model = weights.groupBy("run", "pid").agg(F.avg("weight").alias("weight"))
    low = constraints.where("status = 'used'").select("run", "pid").distinct()
    labels = temporal.labelled_availability(annual, member, model, low, obs, pca.min_series_per_year, cfg.multiresolution.support_multiplier)
    support = labels.join(support, ["run", "year"], "left").na.fill(0, ["contributing_nests", "maximum_core_count"])
    return Reconstruction(series, nests, payloads(tagged, "selection", SELECTION), payloads(tagged, "layer", LAYERS), weights, support, points.select("run", "nest_id", "year", "runs", "core_count", "start", "end"), annual, constraints, payloads(tagged, "slow_sample", OBSERVATIONS), grid)


def score_names(cfg: ReconstructionConfig) -> list[str]:
    """The metrics of ``score_runs``, in their order."""
    none = np.array([])
    one = skills.skill(none, none, none)
    return [*one, *[f"raw_{k}" for k in one], *skills.multiscale(none, none, none, cfg.evaluation.lowpass_periods), *skills.spectral(none, none, none, cfg.evaluation.period_bands)]


def score_runs(series: DataFrame, target: dict[int, float], held: dict[str, Sequence[int]], train: dict[str, Sequence[int]], cfg: ReconstructionConfig) -> DataFrame:
    """(run, metric, value): skill of each run's point on its held-out years, at all scales."""

    def score(group: pd.DataFrame) -> pd.DataFrame:
        run = group["run"].iloc[0]
        group = group.sort_values("year")
        group = group[group["year"].isin(held[run])]
        years = group["year"].to_numpy(dtype=int)
        o = np.array([target.get(int(t), np.nan) for t in years])
        learned = [target[t] for t in train[run] if t in target]
        mean = float(np.mean(learned)) if learned else None
        out = {}
        for prefix, column in (("", "point"), ("raw_", "point_raw")):
            out |= {prefix + k: v for k, v in skills.skill(o, group[column].to_numpy(dtype=float), years, mean).items()}
        p = group["point"].to_numpy(dtype=float)
        out |= skills.multiscale(o, p, years, cfg.evaluation.lowpass_periods, mean) | skills.spectral(o, p, years, cfg.evaluation.period_bands)
        return pd.DataFrame({"run": run, "metric": list(out), "value": [float(v) if np.isfinite(v) else None for v in out.values()]})

    return series.select("run", "year", "point", "point_raw").groupBy("run").applyInPandas(score, "run string, metric string, value double")


def outer_validation(obs, records, selected, target, pca=PCAConfig(), cfg=ReconstructionConfig(), scr=ScreeningConfig(), rescreen: bool = False) -> DataFrame:
    """(run, metric, value) of the early and the late part, each held out from everything; contiguous blocks judge the candidates inside.

    With ``rescreen`` each fold selects its series anew from its training years. A fold that fails has
    the metric ``failed`` only.
    """
    values = target_years(target)
    years = sorted(values)
    spark = obs.sparkSession
    table = edge_folds(spark.createDataFrame([(y,) for y in years], "year int"), cfg.evaluation.external_fraction, least_train=max(20, pca.max_components + 3)).collect()
    held = {f"{name}": sorted(r["year"] for r in table if r["fold"] == k) for k, name in enumerate(("early", "late"))}
    held = {k: v for k, v in held.items() if v}
    train = {k: [y for y in years if y not in set(v)] for k, v in held.items()}
    inner = having(cfg, {"ensemble.members": 0 if cfg.method == "explicit_nest" else cfg.ensemble.members, "gaps.longest_only": False})
    if not rescreen:
        runs = spark.createDataFrame([(n,) for n in train], "run string")
        got = reconstruct(obs, records, selected, target, pca, inner, scr, selected.select("pid").crossJoin(runs).select("run", "pid"), train)
        return score_runs(got.series, values, held, train, cfg)
    return _rescreened(obs, records, target, pca, inner, scr, train, held, values, cfg)


def _rescreened(obs, records, target, pca, inner, scr, train, held, values, cfg) -> DataFrame:
    """Runs that screen on their own training years; as each has its own seasons, they are fitted one after another."""
    spark = obs.sparkSession
    out = spark.createDataFrame([], "run string, metric string, value double")
    for run, years in train.items():
        learn = target.join(spark.createDataFrame([(y,) for y in years], "year int"), "year", "left_semi")
        own = kept(screen(obs, records, learn, replace(scr, period=None)).where("selected").select("pid", F.coalesce("season", F.lit("")).alias("season")))
        if own.isEmpty():
            part = spark.createDataFrame([(run, "failed", 1.0)], "run string, metric string, value double")
        else:
            got = reconstruct(obs, records, own, target, pca, inner, scr, own.select(F.lit(run).alias("run"), "pid"), {run: years})
            part = score_runs(got.series, values, held, train, cfg)
        out = out.unionByName(kept(part))
    return out


def sensitivities(obs, records, selected, target, config: PipelineConfig) -> DataFrame:
    """(run, metric, value) of refits with single series, one left out, random deletions, and split periods screened anew."""
    cfg, sens = having(config.reconstruction, {"gaps.longest_only": False}), config.sensitivity
    values = target_years(target)
    years = sorted(values)
    pids = [r["pid"] for r in selected.select("pid").orderBy("pid").collect()]
    networks: list[tuple[str, str]] = []
    train: dict[str, list[int]] = {}

    def add(run: str, members: Sequence[str]) -> None:
        networks.extend((run, p) for p in members)
        train[run] = years

    if sens.single:
        for p in pids:
            add(f"single:{p}", [p])
    if sens.leave_one_out and len(pids) > 2:
        for p in pids:
            add(f"without:{p}", [q for q in pids if q != p])
    for k in range(sens.delete_repeats):
        rng = np.random.default_rng(np.random.SeedSequence([cfg.ensemble.seed, k]))
        keep = max(2, int(np.ceil(len(pids) * (1 - sens.delete_fraction))))
        add(f"deletion:{k}", sorted(rng.choice(pids, min(keep, len(pids)), replace=False).tolist()))
    small = having(cfg, {"nest.minimum_members": 1, "nest.minimum_core": 1, "ensemble.members": 0})
    pca = replace(config.pca, min_series_per_year=1)
    out = obs.sparkSession.createDataFrame([], "run string, metric string, value double")
    if networks:
        table = obs.sparkSession.createDataFrame(networks, "run string, pid string")
        got = reconstruct(obs, records, selected, target, pca, small, config.screening, table, train)
        out = out.unionByName(score_runs(got.series, values, train, train, cfg))
    if sens.split_periods:
        names = {f"split:{a}-{b}:{c}-{e}": ((a, b), (c, e)) for (a, b), (c, e) in sens.split_periods}
        part = lambda bounds: [t for t in years if bounds[0] <= t <= bounds[1]]
        learn, score = ({k: part(v[i]) for k, v in names.items()} for i in (0, 1))
        out = out.unionByName(_rescreened(obs, records, target, pca, small, config.screening, learn, score, values, cfg))
    return out


def tune_slow_layer(obs, records, selected, target, pca=PCAConfig(), cfg=ReconstructionConfig(), scr=ScreeningConfig()) -> tuple[ReconstructionConfig, DataFrame]:
    """(settings with the best constraint weight and period, table of the grid).

    On contiguous folds the annual core is reconstructed without slow series; each candidate then corrects
    it, learning from the fold's training years, and is judged by its annual and low-pass skill on the held
    years. No correction is always a candidate, and wins ties.
    """
    slow_cfg = cfg.multiresolution
    values = target_years(target)
    folds = skills.blocked_folds(np.array(sorted(values)), cfg.evaluation.block_years, cfg.evaluation.minimum_train)
    train = {f"fold_{k}": t.tolist() for k, (t, _) in enumerate(folds)}
    held = {f"fold_{k}": h.tolist() for k, (_, h) in enumerate(folds)}
    limit = cfg.nest.subnest_max_resolution if cfg.nest.subnests else slow_cfg.regression_max_resolution
    slow = records.where(F.col("resolution") > limit).select("pid")
    samples = obs.join(slow, "pid", "left_semi").join(selected.select("pid"), "pid", "left_semi")
    none = having(cfg, {"multiresolution.constraint_weight": 0.0, "multiresolution.auto_tune": False})
    schema = "run string, weight double, period double, used int, annual_ce double, annual_r double, lowpass_ce double, lowpass_r double"
    if len(folds) < slow_cfg.minimum_folds:
        return none, obs.sparkSession.createDataFrame([], schema)
    runs = obs.sparkSession.createDataFrame([(n,) for n in train], "run string")
    core_cfg = having(cfg, {"ensemble.members": 0, "gaps.longest_only": False, "multiresolution.enabled": False})
    core = reconstruct(obs, records, selected.join(slow, "pid", "left_anti"), target, pca, core_cfg, scr, selected.join(slow, "pid", "left_anti").select("pid").crossJoin(runs).select("run", "pid"), train).series
    rows = core.select("run", F.lit(None).cast("string").alias("pid"), F.col("year").cast("double").alias("x"), F.col("point").alias("y")).unionByName(samples.crossJoin(runs).select("run", "pid", F.col("time").alias("x"), F.col("value").alias("y")))

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        run = group["run"].iloc[0]
        own = group[group["pid"].isna()].sort_values("x")
        series = [(p, g["x"].to_numpy(dtype=float), g["y"].to_numpy(dtype=float)) for p, g in group[group["pid"].notna()].sort_values("x").groupby("pid")]
        out = []
        if len(own):
            years = np.arange(int(own["x"].min()), int(own["x"].max()) + 1)
            point = np.full(len(years), np.nan)
            point[own["x"].to_numpy(dtype=int) - years[0]] = own["y"].to_numpy(dtype=float)
            learn = np.array(train[run])
            known = np.array([values[int(t)] for t in learn])
            judged = np.array([t for t in held[run] if years[0] <= t <= years[-1]])
            o = np.array([values[int(t)] for t in judged])
            name = f"lowpass_{slow_cfg.selection_period:g}y_".replace(".", "p")
            for weight in sorted({0.0, *slow_cfg.weight_candidates}):
                for period in slow_cfg.period_candidates:
                    got, used = point, 0
                    if weight > 0:
                        got, audit = assimilate(years, point, series, learn, known, replace(slow_cfg, constraint_weight=weight, lowpass_period=period))
                        used = sum(a["status"] == "used" for a in audit)
                    p = got[judged - years[0]]
                    a, m = skills.skill(o, p, judged, float(known.mean())), skills.multiscale(o, p, judged, (slow_cfg.selection_period,), float(known.mean()))
                    out.append((run, weight, period, used, a["ce"], a["r"], m[name + "ce"], m[name + "r"]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    fold_table = kept(rows.groupBy("run").applyInPandas(judge, schema))
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("annual_ce", "annual_r", "lowpass_ce", "lowpass_r")]
    grid = fold_table.select("run", "weight", "period", "used", *clean).groupBy("weight", "period").agg(F.count_distinct("run").alias("folds"), *[F.median(c).alias(c) for c in ("annual_ce", "annual_r", "lowpass_ce", "lowpass_r")])
    grid = kept(grid.withColumn("objective", F.least("annual_ce", "lowpass_ce") + 0.1 * F.col("lowpass_r")))
    best = grid.where("objective is not null and folds >= " + str(slow_cfg.minimum_folds)).orderBy(F.desc("objective"), "weight", "period").first()
    if best is None:
        return none, grid
    return having(cfg, {"multiresolution.constraint_weight": best["weight"], "multiresolution.lowpass_period": best["period"], "multiresolution.auto_tune": False}), grid


def lowpass_states(annual: DataFrame, period: float) -> DataFrame:
    """(pid, year, value): each series smoothed; gaps have no weight but a smoothed value."""

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        grid, v = lowpass(group["year"].to_numpy(), group["value"].to_numpy(dtype=float), period)
        return pd.DataFrame({"pid": group["pid"].iloc[0], "year": grid, "value": v})

    return annual.groupBy("pid").applyInPandas(smooth, "pid string, year int, value double")




