"""Queries of the kernels. SQL does not express them; tests check the kernels against independent formulas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..config import PCAConfig, PipelineConfig, ReconstructionConfig, ScreeningConfig, SensitivityConfig, having
from ..functions.storage import kept
from ..kernels import skill, smooth
from ..operators import temporal
from ..sources import supplied
from . import reconstruct as rec
from .catalogue import annual_of, pairs_of, query, r6

#: Small ensembles over weeks as years; signals are weak, so the gate is open.
DEMO = having(ReconstructionConfig(), {"ensemble.members": 50, "gates.ce": -10.0, "gates.re": -10.0, "nest.span": 200, "nest.minimum_start": 0})


def _inputs(spark, d):
    """Weekly series, of every fifth brand means of three weeks; all are selected.

    Written once: the plans read each of them many times, and sales would be joined and averaged anew each time.
    """
    k = F.regexp_extract("pid", "([0-9]+)", 1).cast("int")
    time = F.when(k % 5 == 0, F.floor(F.col("time") / 3) * 3).otherwise(F.col("time")).cast("double")
    obs = kept(supplied.weekly(spark, d).groupBy("pid", time.alias("time")).agg(F.avg("value").alias("value")))
    records = kept(supplied.records(spark, d).join(temporal.native_resolution(obs), "pid"))
    return obs, records, records.select("pid", F.lit("").alias("season")), kept(supplied.weekly_target(spark, d))


@query()
def nest_pcr_ensemble(spark, d):
    return rec.reconstruct(*_inputs(spark, d), PCAConfig(), DEMO).series.orderBy("year")


@query()
def nest_ensemble_500(spark, d):
    """(nests, regressions): how many nests were fitted with 500 random calibrations each, and so many regressions. Brands begin and end in different weeks, so that there are many nests."""
    obs, records, selected, target = _inputs(spark, d)
    k = F.regexp_extract("pid", "([0-9]+)", 1).cast("int")
    obs = obs.where(F.col("time").between(k * 3 % 40, 300 + k * 7 % 45))
    got = rec.reconstruct(obs, records, selected, target, PCAConfig(), having(DEMO, {"ensemble.members": 500}))
    points = got.members.where("runs is not null").groupBy("nest_id").agg(F.max(F.size("runs")).alias("k"))
    return points.agg(F.count(F.lit(1)).alias("nests"), F.sum("k").cast("long").alias("regressions"))


@query()
def nest_audit(spark, d):
    return rec.reconstruct(*_inputs(spark, d), PCAConfig(), DEMO).nests


@query()
def resolution_layers(spark, d):
    return rec.reconstruct(*_inputs(spark, d), PCAConfig(), DEMO).layers


@query()
def native_missing_series(spark, d):
    return rec.reconstruct(*_inputs(spark, d), PCAConfig(), having(DEMO, {"method": "native_missing", "nest.subnests": False})).series


@query()
def outer_fold_skill(spark, d):
    return rec.outer_validation(*_inputs(spark, d), PCAConfig(), having(DEMO, {"ensemble.members": 0}))


@query()
def external_validation_folds(spark, d):
    """Contiguous outer blocks in both modes, one row a fold."""
    from . import outer

    cfg = having(DEMO, {"ensemble.members": 0, "evaluation.outer_folds": "blocks", "evaluation.block_years": 120})
    scr = ScreeningConfig(p_threshold=1.0, r_threshold=0.05)
    return outer.external_validation(*_inputs(spark, d), PCAConfig(), cfg, scr, (outer.FULL, outer.RESCREENED))


@query()
def deletion_sensitivity(spark, d):
    config = PipelineConfig(reconstruction=DEMO, sensitivity=SensitivityConfig(delete_repeats=2, split_periods=(((0, 200), (201, 340)),)))
    return rec.sensitivities(*_inputs(spark, d), config)


@query()
def lowpass_state(spark, d):
    return rec.lowpass_states(annual_of(spark, d), 10.0).select("pid", "year", r6("value").alias("value"))


def _by_series(df, f, schema):
    return df.groupBy("pid").applyInPandas(f, schema)


@query()
def resolution_fusion(spark, d):
    """Each brand's weekly means drawn towards its own five-week means."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("year")
        years, core = g["year"].to_numpy(), g["x"].to_numpy(dtype=float)
        windows = [(int(a), int(a) + 4, g.loc[(g["year"] >= a) & (g["year"] < a + 5), "y"].mean(skipna=True).reshape(1)) for a in range(int(years[0]), int(years[-1]) - 4, 5) if ((g["year"] >= a) & (g["year"] < a + 5)).any()]
        out, _ = smooth.fuse(years, core, windows, 1.0, 1.0)
        return pd.DataFrame({"pid": g["pid"].iloc[0], "year": years, "value": out[:, 0]})

    return _by_series(pairs_of(spark, d), work, "pid string, year int, value double")


@query()
def lowfreq_adjustment(spark, d):
    """Each brand's series corrected in its slow part by its own thinned samples."""
    from ..config import MultiresolutionConfig

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("year")
        years, core, y = g["year"].to_numpy(), g["x"].to_numpy(dtype=float), g["y"].to_numpy(dtype=float)
        out, _ = smooth.assimilate(years, core, [("slow", years[::12].astype(float), y[::12])], years, y, MultiresolutionConfig(enabled=True))
        return pd.DataFrame({"pid": g["pid"].iloc[0], "year": years, "value": out})

    return _by_series(pairs_of(spark, d), work, "pid string, year int, value double")


@query()
def spectral_skill(spark, d):
    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("year")
        got = skill.spectral(g["y"].to_numpy(dtype=float), g["x"].to_numpy(dtype=float), g["year"].to_numpy(), ((4.0, 10.0), (10.0, 30.0)))
        return pd.DataFrame({"pid": g["pid"].iloc[0], "metric": list(got), "value": list(got.values())})

    return _by_series(pairs_of(spark, d), work, "pid string, metric string, value double")


@query()
def full_pipeline(spark, d):
    """From the source table to the reconstruction, with filter, deduplication and screening."""
    from ..config import ScreeningConfig
    from .pipeline import run_pipeline

    obs, records, _, target = _inputs(spark, d)
    packed = obs.join(records, "pid").groupBy("pid", "lat", "lon", "archive", "proxy").agg(F.collect_list("time").alias("year"), F.collect_list("value").alias("paleoData_values"))
    source = packed.select(F.col("pid").alias("datasetId"), "year", "paleoData_values", F.lit("AD").alias("yearUnits"), F.col("lat").alias("geo_meanLat"), F.col("lon").alias("geo_meanLon"), F.col("archive").alias("archiveType"), F.col("proxy").alias("paleoData_proxy"))
    config = PipelineConfig(screening=ScreeningConfig(p_threshold=1.0, r_threshold=0.05), reconstruction=having(DEMO, {"ensemble.members": 30}))
    return run_pipeline(source, target.select(F.col("year").alias("Year"), F.col("y").alias("value")), config).reconstruction.series
