"""Settings of the workflow: one table of all of them, from which the groups that operators take are made.

A setting has a place in the groups (``reconstruction.ensemble.members``), a rule that its value must meet,
a default, and the name that it has in JSON files. A group is a frozen dataclass; ``having`` changes some
settings of a group or of groups inside it by their places.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import field, fields, make_dataclass, replace
from pathlib import Path
from typing import Any

Rule = tuple[str, Callable[[Any], bool]]

ANY: Rule = ("anything", lambda v: True)
FLAG: Rule = ("true or false", lambda v: isinstance(v, bool))
SHARE: Rule = ("above 0 and at most 1", lambda v: 0 < v <= 1)
CORRELATION: Rule = ("between 0 and 1", lambda v: 0 <= v <= 1)
MINOR_SHARE: Rule = ("above 0 and below 0.5", lambda v: 0 < v < 0.5)
BOUNDS: Rule = ("two bounds, the lower first", lambda v: v is None or None in v or v[0] <= v[1])
WIDTHS: Rule = ("widths that grow", lambda v: bool(v) and all(a < b for a, b in zip(v, v[1:])))
MONTHS: Rule = ("months from 1 to 12", lambda v: bool(v) and set(v) <= set(range(1, 13)))
SEASON_LIST: Rule = ("lists of months from 1 to 12", lambda v: all(MONTHS[1](s) for s in v))
CAPS: Rule = ("pairs of distinct archives and positive numbers", lambda v: len({n.strip().lower() for n, _ in v}) == len(v) and all(k >= 1 for _, k in v))
ERRORS: Rule = ("pairs of distinct series and positive numbers", lambda v: len({p for p, _ in v}) == len(v) and all(e > 0 for _, e in v))
BANDS: Rule = ("pairs of growing periods above 2", lambda v: all(2 < a < b for a, b in v))


def least(low: float) -> Rule:
    return (f"at least {low}", lambda v: v >= low)


def over(low: float) -> Rule:
    return (f"above {low}", lambda v: v > low)


def among(*names: str) -> Rule:
    return ("one of " + ", ".join(names), lambda v: v in names)


def some_of(*names: str) -> Rule:
    return ("distinct names out of " + ", ".join(names), lambda v: bool(v) and len(set(v)) == len(v) and set(v) <= set(names))


def each(rule: Rule) -> Rule:
    return (f"values {rule[0]}", lambda v: bool(v) and all(map(rule[1], v)))


def or_none(rule: Rule) -> Rule:
    return (f"nothing or {rule[0]}", lambda v: v is None or rule[1](v))


ALL_MONTHS = tuple(range(1, 13))
AMPLITUDES = ("none", "ols", "variance_observation", "variance_max_proxy_nest", "dynamic_variance")
REGRESSIONS = ("ols", "ridge", "pls", "elasticnet", "random_forest")
#: The seasons tried for series finer than a year.
SEASONS = (ALL_MONTHS, (12, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10, 11), (5, 6, 7, 8, 9), (6, 7, 8, 9, 10))

# The names in JSON files and the defaults. Files and results depend on them.
# (place in the groups, name in JSON files, default, rule)
SETTINGS: tuple[tuple[str, str, Any, Rule], ...] = (
    # which rows of the source take part
    ("filter.deduplicate_exact", "proxy_filter.deduplicate_exact", True, FLAG),
    ("filter.deduplicate_near", "proxy_filter.deduplicate_near", True, FLAG),
    ("filter.archives", "proxy_filter.archives", (), ANY),
    ("filter.proxies", "proxy_filter.proxies", (), ANY),
    ("filter.climate_variables", "proxy_filter.climate_variables", (), ANY),
    ("filter.latitude", "proxy_filter.latitude", None, BOUNDS),
    ("filter.longitude", "proxy_filter.longitude", None, ANY),
    ("filter.maximum_plausible_year", "proxy_filter.maximum_plausible_year", 2100.0, ANY),
    ("filter.maximum_resolution_years", "proxy_filter.maximum_resolution_years", None, or_none(over(0))),
    # how months become years, and what is taken off the target
    ("target.year_column", "target.year_column", "Year", ANY),
    ("target.value_column", "target.value_column", None, ANY),
    ("target.months", "target.months", ALL_MONTHS, MONTHS),
    ("target.anchor", "target.season_year", "end", among("end", "start", "calendar")),
    ("target.month_fraction", "target.minimum_month_fraction", 0.75, SHARE),
    ("target.detrend", "target.detrend", False, FLAG),
    ("target.lowpass_years", "target.lowpass_years", None, or_none(over(2))),
    ("target.lowpass_order", "target.lowpass_order", 4, least(1)),
    ("screening.season_mode", "screening.season_mode", "auto", among("auto", "fixed")),
    ("screening.season_candidates", "screening.season_candidates", SEASONS, SEASON_LIST),
    ("screening.months", "screening.months", ALL_MONTHS, MONTHS),
    ("screening.anchor", "screening.season_year", "end", among("end", "start", "calendar")),
    ("screening.month_fraction", "screening.minimum_month_fraction", 0.75, SHARE),
    # which series track the target
    ("screening.detrend", "screening.detrend", False, FLAG),
    ("screening.period", "screening.period", None, BOUNDS),
    ("screening.min_overlap", "screening.min_overlap", 20, least(4)),
    ("screening.low_resolution_min_overlap", "screening.low_resolution_min_overlap", 8, or_none(least(4))),
    ("screening.low_resolution_cutoff", "screening.low_resolution_cutoff_years", 1.5, over(0)),
    ("screening.pairing", "screening.low_resolution_pairing", "window", among("window", "annual")),
    ("screening.native_window_cutoff", "screening.native_window_cutoff_years", 1.5, over(0)),
    ("screening.native_window_bins", "screening.native_window_bins", (2, 3, 5, 10), WIDTHS),
    ("screening.p_threshold", "screening.p_threshold", 0.10, SHARE),
    ("screening.r_threshold", "screening.r_threshold", 0.0, CORRELATION),
    ("screening.multiple_testing", "screening.multiple_testing", "holm", among("holm", "none")),
    ("screening.proxy_multiple_testing", "screening.proxy_multiple_testing", "fdr_bh", among("fdr_bh", "holm", "none")),
    ("screening.archive_max_counts", "screening.archive_max_counts", (), CAPS),
    # components of a nest's matrix
    ("pca.method", "pca.method", "pairwise", among("pairwise", "complete")),
    ("pca.selection", "pca.selection", "kaiser", among("kaiser", "kaiser_cv", "variance", "fixed", "blocked_cv")),
    ("pca.n_components", "pca.n_components", None, or_none(least(1))),
    ("pca.max_components", "pca.max_components", 8, least(1)),
    ("pca.kaiser_threshold", "pca.kaiser_threshold", 1.0, over(0)),
    ("pca.variance_fraction", "pca.variance_fraction", 0.90, SHARE),
    ("pca.min_pairwise_overlap", "pca.min_pairwise_overlap", 10, least(1)),
    ("pca.min_series_per_year", "pca.min_proxies_per_year", 2, least(1)),
    ("pca.score_ridge", "pca.score_ridge", 0.10, least(0)),
    # weights of series within a nest
    ("reconstruction.weights.enabled", "reconstruction.proxy_weights.enabled", False, FLAG),
    ("reconstruction.weights.error_fields", "reconstruction.proxy_weights.error_sd_fields", ("paleoData_uncertainty", "paleoData_error", "measurement_error", "error_sd"), ANY),
    ("reconstruction.weights.explicit_error_sd", "reconstruction.proxy_weights.explicit_error_sd", (), ERRORS),
    ("reconstruction.weights.minimum_weight", "reconstruction.proxy_weights.minimum_weight", 0.10, SHARE),
    ("reconstruction.weights.radius_km", "reconstruction.proxy_weights.redundancy_radius_km", 250.0, least(0)),
    ("reconstruction.weights.correlation", "reconstruction.proxy_weights.redundancy_correlation_threshold", 0.85, CORRELATION),
    ("reconstruction.weights.min_overlap", "reconstruction.proxy_weights.redundancy_min_overlap", 20, least(4)),
    ("reconstruction.weights.same_archive_only", "reconstruction.proxy_weights.same_archive_only", True, FLAG),
    ("reconstruction.weights.same_proxy_only", "reconstruction.proxy_weights.same_proxy_only", True, FLAG),
    # the annual matrix
    ("reconstruction.method", "reconstruction.method", "explicit_nest", among("explicit_nest", "native_missing")),
    ("reconstruction.period", "reconstruction.reconstruction_period", None, BOUNDS),
    ("reconstruction.calibration_period", "reconstruction.calibration_period", None, BOUNDS),
    ("reconstruction.standardization_period", "reconstruction.standardization_period", None, BOUNDS),
    ("reconstruction.detrend", "reconstruction.detrend_proxies", False, FLAG),
    ("reconstruction.auto_tune", "reconstruction.auto_tune", True, FLAG),
    ("reconstruction.gaps.fill", "reconstruction.interpolation", "archive_linear", among("none", "archive_linear")),
    ("reconstruction.gaps.archives", "reconstruction.interpolation_archives", ("Wood", "Coral"), ANY),
    ("reconstruction.gaps.most_years", "reconstruction.interpolation_max_gap_years", 2, least(1)),
    ("reconstruction.gaps.coarsest", "reconstruction.interpolation_max_resolution_years", 2.0, over(0)),
    ("reconstruction.gaps.longest_only", "reconstruction.retain_longest_annual_segment", True, FLAG),
    # nests, and the layers of their coarse series
    ("reconstruction.nest.span", "reconstruction.nest.minimum_span_years", 50, least(2)),
    ("reconstruction.nest.minimum_start", "reconstruction.nest.minimum_start_year", 100, ANY),
    ("reconstruction.nest.minimum_members", "reconstruction.nest.minimum_total_proxies", 2, least(1)),
    ("reconstruction.nest.minimum_core", "reconstruction.nest.minimum_core_proxies", 2, least(1)),
    ("reconstruction.nest.minimum_calibration_years", "reconstruction.nest.minimum_calibration_years", 20, least(4)),
    ("reconstruction.nest.combination", "reconstruction.nest.combination", "median", among("median", "densest")),
    ("reconstruction.nest.require_gate", "reconstruction.nest.require_internal_ce_re", True, FLAG),
    ("reconstruction.nest.subnests", "reconstruction.nest.multiresolution_subnests", True, FLAG),
    ("reconstruction.nest.direct_resolution", "reconstruction.nest.direct_annual_resolution_years", 1.5, over(0)),
    ("reconstruction.nest.subnest_max_resolution", "reconstruction.nest.subnest_max_resolution_years", 10.0, over(0)),
    ("reconstruction.nest.bins", "reconstruction.nest.subnest_resolution_bins", (2, 3, 5, 10), WIDTHS),
    ("reconstruction.nest.minimum_windows", "reconstruction.nest.minimum_subnest_calibration_windows", 8, least(4)),
    ("reconstruction.nest.constraint_weight", "reconstruction.nest.subnest_constraint_weight", 1.0, least(0)),
    ("reconstruction.nest.smoothness", "reconstruction.nest.subnest_smoothness_multiplier", 1.0, least(0)),
    # regressions of the target on components
    ("reconstruction.regression.family", "reconstruction.regression", "ols", among("auto", *REGRESSIONS)),
    ("reconstruction.regression.families", "reconstruction.regression_candidates", ("ridge", "pls", "elasticnet"), some_of(*REGRESSIONS)),
    ("reconstruction.regression.alphas", "reconstruction.ridge_alphas", (0.0, 1.0, 10.0), ANY),
    ("reconstruction.regression.pls_components", "reconstruction.pls_components", 2, least(1)),
    ("reconstruction.regression.trees", "reconstruction.random_forest_trees", 500, least(1)),
    ("reconstruction.regression.min_leaf", "reconstruction.random_forest_min_samples_leaf", 5, least(1)),
    ("reconstruction.regression.max_features", "reconstruction.random_forest_max_features", 1.0, SHARE),
    # members and their random calibrations
    ("reconstruction.ensemble.members", "reconstruction.n_bootstrap", 500, least(0)),
    ("reconstruction.ensemble.scheme", "reconstruction.bootstrap_method", "random_holdout", among("random_holdout", "moving_block")),
    ("reconstruction.ensemble.holdout_fraction", "reconstruction.bootstrap_validation_fraction", 1.0 / 3.0, MINOR_SHARE),
    ("reconstruction.ensemble.block", "reconstruction.bootstrap_block_years", 5, least(1)),
    ("reconstruction.ensemble.success_fraction", "reconstruction.minimum_bootstrap_success_fraction", 0.80, SHARE),
    ("reconstruction.ensemble.seed", "reconstruction.random_seed", 20260926, least(0)),
    # what a nest must reach
    ("reconstruction.gates.ce", "reconstruction.min_ce", 0.1, ANY),
    ("reconstruction.gates.re", "reconstruction.min_re", 0.1, ANY),
    ("reconstruction.gates.comparison", "reconstruction.internal_ce_re_comparison", "gt", among("ge", "gt")),
    ("reconstruction.gates.floor", "reconstruction.skill_floor", 0.0, ANY),
    # maps that restore the amplitude
    ("reconstruction.amplitude.method", "reconstruction.amplitude.method", "auto", among("none", "ols", "variance", "dynamic_variance", "auto")),
    ("reconstruction.amplitude.candidates", "reconstruction.amplitude.auto_candidates", ("variance_observation", "variance_max_proxy_nest"), some_of(*AMPLITUDES)),
    ("reconstruction.amplitude.reference", "reconstruction.amplitude.variance_reference", "observation", among("observation", "max_proxy_nest")),
    ("reconstruction.amplitude.minimum_overlap", "reconstruction.amplitude.minimum_overlap", 20, least(4)),
    ("reconstruction.amplitude.slope_bounds", "reconstruction.amplitude.slope_bounds", (0.25, 4.0), ("positive bounds, the lower first", lambda v: 0 < v[0] <= v[1])),
    ("reconstruction.amplitude.sd_ratio_weight", "reconstruction.amplitude.auto_sd_ratio_weight", 0.10, least(0)),
    ("reconstruction.amplitude.max_bins", "reconstruction.amplitude.dynamic_max_bins", 4, least(2)),
    ("reconstruction.amplitude.bin_years", "reconstruction.amplitude.dynamic_minimum_bin_years", 15, least(4)),
    ("reconstruction.amplitude.shrinkage_years", "reconstruction.amplitude.dynamic_shrinkage_years", 15.0, least(0)),
    # slow series
    ("reconstruction.multiresolution.enabled", "reconstruction.multiresolution.enabled", False, FLAG),
    ("reconstruction.multiresolution.regression_max_resolution", "reconstruction.multiresolution.regression_max_resolution_years", 10.0, over(0)),
    ("reconstruction.multiresolution.direct_max_resolution", "reconstruction.multiresolution.direct_pcr_max_resolution_years", 1.5, over(0)),
    ("reconstruction.multiresolution.constraint_weight", "reconstruction.multiresolution.proxy_constraint_weight", 1.0, least(0)),
    ("reconstruction.multiresolution.lowpass_period", "reconstruction.multiresolution.lowpass_period_years", 10.0, over(2)),
    ("reconstruction.multiresolution.smoothness", "reconstruction.multiresolution.smoothness_multiplier", 1.0, least(0)),
    ("reconstruction.multiresolution.anchor_weight", "reconstruction.multiresolution.core_anchor_weight", 1.0, least(0)),
    ("reconstruction.multiresolution.support_multiplier", "reconstruction.multiresolution.maximum_support_multiplier", 3.0, or_none(over(0))),
    ("reconstruction.multiresolution.increment_ratio", "reconstruction.multiresolution.maximum_increment_ratio", 1.0, or_none(over(0))),
    ("reconstruction.multiresolution.preserve_mean", "reconstruction.multiresolution.preserve_calibration_mean", True, FLAG),
    ("reconstruction.multiresolution.minimum_overlap", "reconstruction.multiresolution.minimum_calibration_overlap", 8, least(4)),
    ("reconstruction.multiresolution.auto_tune", "reconstruction.multiresolution.auto_tune", True, FLAG),
    ("reconstruction.multiresolution.weight_candidates", "reconstruction.multiresolution.proxy_constraint_weight_candidates", (0.0, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0), each(least(0))),
    ("reconstruction.multiresolution.period_candidates", "reconstruction.multiresolution.lowpass_period_candidates", (3.0, 5.0, 10.0, 20.0), each(over(2))),
    ("reconstruction.multiresolution.selection_period", "reconstruction.multiresolution.selection_lowpass_period_years", 10.0, over(2)),
    ("reconstruction.multiresolution.minimum_folds", "reconstruction.multiresolution.minimum_tuning_folds", 2, least(1)),
    # folds and scales of validation
    ("reconstruction.evaluation.block_years", "reconstruction.validation_block_years", 34, least(2)),
    ("reconstruction.evaluation.minimum_train", "reconstruction.minimum_internal_train_samples", 20, least(4)),
    ("reconstruction.evaluation.lowpass_periods", "reconstruction.evaluation_lowpass_periods", (10.0, 20.0), each(over(2))),
    ("reconstruction.evaluation.period_bands", "reconstruction.evaluation_period_bands", ((10.0, 30.0),), BANDS),
    ("reconstruction.evaluation.external_fraction", "reconstruction.external_validation_fraction", 1.0 / 3.0, MINOR_SHARE),
    ("reconstruction.evaluation.outer_folds", "reconstruction.outer_folds", "edges", among("edges", "blocks")),
    ("reconstruction.evaluation.outer", "reconstruction.full_network_outer_validation", False, FLAG),
    ("reconstruction.evaluation.rescreen", "reconstruction.rescreen_outer_folds", False, FLAG),
    ("sensitivity.single", "sensitivity.single_proxy", False, FLAG),
    ("sensitivity.leave_one_out", "sensitivity.leave_one_proxy_out", False, FLAG),
    ("sensitivity.delete_repeats", "sensitivity.random_delete_repeats", 0, least(0)),
    ("sensitivity.delete_fraction", "sensitivity.random_delete_fraction", 0.20, ("at least 0 and below 1", lambda v: 0 <= v < 1)),
    ("sensitivity.split_periods", "sensitivity.split_periods", (), ANY),
    ("output.directory", "output.directory", "results", ANY),
    ("output.save_reconstruction", "output.save_reconstruction", True, FLAG),
    ("output.save_screening", "output.save_screening", True, FLAG),
    ("output.save_metrics", "output.save_metrics", True, FLAG),
    ("output.show_external", "output.show_external_sensitivities", False, FLAG),
)

# Names that files may have and that change nothing here (plots, an annual grid, an old threshold).
WITHOUT_EFFECT = frozenset({"reconstruction.multiresolution.state_timestep_years", "reconstruction.strong_skill_threshold", "output.save_proxy_map", "output.save_observation_plot", "output.save_nests", "output.figure_format"})

#: What settings of one group must be to each other.
TOGETHER: dict[str, tuple[tuple[str, Callable[[Any], bool]], ...]] = {
    "screening": (("native_window_bins must lie above native_window_cutoff", lambda g: g.native_window_bins[0] > g.native_window_cutoff),),
    "pca": (("fixed selection needs n_components", lambda g: g.selection != "fixed" or g.n_components is not None),),
    "reconstruction.gaps": (("archive_linear needs distinct archives", lambda g: g.fill == "none" or 0 < len(g.archives) == len({a.strip().lower() for a in g.archives})),),
    "reconstruction.multiresolution": (("direct_max_resolution must not exceed regression_max_resolution", lambda g: g.direct_max_resolution <= g.regression_max_resolution),),
    "reconstruction.nest": (("bins must lie above direct_resolution and up to subnest_max_resolution", lambda g: g.direct_resolution < g.bins[0] and g.bins[-1] <= g.subnest_max_resolution),),
}


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _group(name: str, place: str) -> type:
    """The dataclass of the settings at ``place`` and of the groups inside it."""
    start = place + "." if place else ""
    rules: dict[str, Rule] = {}
    members: dict[str, Any] = {}
    for path, _, default, rule in SETTINGS:
        if path.startswith(start):
            head, dot, _ = path[len(start) :].partition(".")
            if dot:
                members[head] = field(default_factory=GROUPS[start + head])
            else:
                members[head], rules[head] = default, rule

    def check(self) -> None:
        for key, (what, holds) in rules.items():
            need(holds(getattr(self, key)), f"{start}{key} must be {what}")
        for message, holds in TOGETHER.get(place, ()):
            need(holds(self), message)

    made = make_dataclass(name, [(k, Any, v) for k, v in members.items()], frozen=True, namespace={"__post_init__": check}, module=__name__)
    GROUPS[place] = made
    return made


GROUPS: dict[str, type] = {}
FilterConfig = _group("FilterConfig", "filter")
TargetConfig = _group("TargetConfig", "target")
ScreeningConfig = _group("ScreeningConfig", "screening")
PCAConfig = _group("PCAConfig", "pca")
WeightConfig = _group("WeightConfig", "reconstruction.weights")
GapConfig = _group("GapConfig", "reconstruction.gaps")
NestConfig = _group("NestConfig", "reconstruction.nest")
RegressionConfig = _group("RegressionConfig", "reconstruction.regression")
EnsembleConfig = _group("EnsembleConfig", "reconstruction.ensemble")
GateConfig = _group("GateConfig", "reconstruction.gates")
AmplitudeConfig = _group("AmplitudeConfig", "reconstruction.amplitude")
MultiresolutionConfig = _group("MultiresolutionConfig", "reconstruction.multiresolution")
EvaluationConfig = _group("EvaluationConfig", "reconstruction.evaluation")
ReconstructionConfig = _group("ReconstructionConfig", "reconstruction")
SensitivityConfig = _group("SensitivityConfig", "sensitivity")
OutputConfig = _group("OutputConfig", "output")
PipelineConfig = _group("PipelineConfig", "")


def having(settings: Any, values: dict[str, Any]) -> Any:
    """``settings`` with other values at some places, such as {"ensemble.members": 20}; a group takes a group."""
    own: dict[str, Any] = {}
    inner: dict[str, dict[str, Any]] = {}
    for place, value in values.items():
        head, dot, rest = place.partition(".")
        need(head in {f.name for f in fields(settings)}, f"{type(settings).__name__} has no {head}")
        if dot:
            inner.setdefault(head, {})[rest] = value
        else:
            own[head] = value
    # a group changes at once, as its settings must fit each other
    return replace(settings, **own, **{k: having(getattr(settings, k), v) for k, v in inner.items()})


def _flat(values: dict[str, Any], start: str = ""):
    for key, value in values.items():
        if isinstance(value, dict):
            yield from _flat(value, f"{start}{key}.")
        else:
            yield start + key, value


def _tuples(value: Any) -> Any:
    return tuple(map(_tuples, value)) if isinstance(value, list) else value


def from_json(values: dict[str, Any]) -> Any:
    """Settings from nested JSON values under their JSON names; unknown names are errors."""
    places = {name: place for place, name, _, _ in SETTINGS}
    given = {name: _tuples(value) for name, value in _flat(values) if name not in WITHOUT_EFFECT}
    unknown = sorted(set(given) - set(places))
    need(not unknown, "no settings are named " + ", ".join(unknown))
    return having(PipelineConfig(), {places[name]: value for name, value in given.items()})


def to_json(settings: Any) -> dict[str, Any]:
    """The settings of a workflow under their JSON names."""
    out: dict[str, Any] = {}
    for place, name, _, _ in SETTINGS:
        value, at = settings, out
        for part in place.split("."):
            value = getattr(value, part)
        *above, last = name.split(".")
        for part in above:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def load_config(path: str) -> Any:
    """Settings from a JSON file."""
    return from_json(json.loads(Path(path).read_text()))


