"""The numerical kernels against plain formulas."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varve.config import AmplitudeConfig, MultiresolutionConfig, PCAConfig, ReconstructionConfig, having
from varve.functions.stats import incomplete_beta, two_sided_p
from varve.kernels import linear, model, skill, smooth


def gappy(seed, n=80, k=5, share=0.2):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=n)
    x = common[:, None] * rng.uniform(0.5, 1.5, k) + rng.normal(scale=0.6, size=(n, k))
    x[rng.random((n, k)) < share] = np.nan
    return x, common


def test_student_tail_has_tabled_values():
    assert two_sided_p(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.0733880, abs=1e-6)
    assert two_sided_p(np.array([12.7062047]), np.array([1.0]))[0] == pytest.approx(0.05, abs=1e-7)
    assert two_sided_p(np.array([1.959964]), np.array([1e7]))[0] == pytest.approx(0.05, abs=1e-5)
    assert incomplete_beta(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] == pytest.approx(0.5248, abs=1e-9)


def test_pairwise_correlation_is_numpys_on_each_pairs_rows():
    x, _ = gappy(1)
    r = linear.pairwise_correlation(x, 10)
    for i in range(5):
        for j in range(i):
            ok = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            assert r[i, j] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-12)
    flat = np.column_stack([np.full(20, 3.3), np.arange(20.0)])
    assert linear.pairwise_correlation(flat, 5)[0, 1] == 0


def test_scores_solve_each_year_by_itself():
    x, _ = gappy(2)
    years = np.arange(80)
    cfg = PCAConfig(max_components=2)
    basis = linear.fit_basis(x, years, np.ones(80, bool), cfg)
    got = linear.scores(basis, x, years, 2, cfg)
    z = basis.standardized(x, years)
    for i in range(80):
        seen = np.isfinite(z[i])
        if seen.sum() >= 2:
            want = np.linalg.lstsq(basis.loadings[seen, :2], z[i, seen], rcond=None)[0]
            assert got[i] == pytest.approx(want, abs=1e-9)
        else:
            assert np.isnan(got[i]).all()


def test_component_rules():
    values = np.array([3, 1.2, 0.9, 0.4])
    assert linear.component_choices(values, PCAConfig()) == [2]
    assert linear.component_choices(values, PCAConfig(selection="kaiser_cv")) == [1, 2]
    assert linear.component_choices(values, PCAConfig(kaiser_threshold=0.8)) == [3]
    assert linear.component_choices(values, PCAConfig(selection="variance", variance_fraction=0.7)) == [2]
    assert linear.component_choices(values, PCAConfig(selection="blocked_cv", max_components=3)) == [1, 2, 3]


def test_regressions_agree_with_their_normal_equations():
    rng = np.random.default_rng(3)
    x, cfg = rng.normal(size=(60, 3)), having(ReconstructionConfig(), {"regression.pls_components": 3, "regression.trees": 30})
    y = 2 + x @ [1.0, -0.5, 0.2] + rng.normal(scale=0.1, size=60)
    design = np.column_stack([np.ones(60), x])
    ols = linear.fit_regression("ols", x, y, 0, cfg)
    assert np.r_[ols.intercept, ols.beta] == pytest.approx(np.linalg.lstsq(design, y, rcond=None)[0])
    ridge = linear.fit_regression("ridge", x, y, 5.0, cfg)
    c = x - x.mean(0)
    assert ridge.beta == pytest.approx(np.linalg.solve(c.T @ c + 5 * np.eye(3), c.T @ (y - y.mean())))
    # with all components partial least squares is least squares
    assert linear.fit_regression("pls", x, y, 0, cfg).beta == pytest.approx(ols.beta, abs=1e-8)
    elastic = linear.fit_regression("elasticnet", x, y, 0.1, cfg).beta
    gradient = -c.T @ (y - y.mean() - c @ elastic) / 60 + 0.1 * 0.5 * elastic
    assert np.all(np.abs(gradient + 0.05 * np.sign(elastic))[elastic != 0] < 1e-7)
    forest = linear.fit_regression("random_forest", x, y, 0, cfg)
    assert np.corrcoef(forest.predict(x), y)[0, 1] > 0.9
    assert (forest.predict(x) == linear.fit_regression("random_forest", x, y, 0, cfg).predict(x)).all()


def test_skill_by_hand():
    got = skill.skill(np.array([1.0, 2, 3]), np.array([1.0, 2, 2]), np.array([1, 2, 3]), 0.0)
    assert got["ce"] == pytest.approx(0.5)
    assert got["re"] == pytest.approx(1 - 1 / 14)


def test_folds_take_every_year_once():
    folds = skill.blocked_folds(np.arange(1900, 2001), 34)
    assert [len(h) for _, h in folds] == [34, 34, 33]
    assert [len(h) for _, h in skill.blocked_folds(np.arange(1900, 2001), 20)] == [20, 20, 20, 20, 21]
    assert skill.blocked_folds(np.arange(10), 3) == []


def test_random_holdouts_are_disjoint_and_repeat():
    train, held = model.holdouts(101, 500, 1 / 3, 7)
    assert train.shape == (500, 67) and held.shape == (500, 34)
    assert all(len(set(t) | set(h)) == 101 for t, h in zip(train, held))
    again, _ = model.holdouts(101, 500, 1 / 3, 7)
    assert (train == again).all()
    with pytest.raises(RuntimeError):
        model.holdouts(6, 3, 1 / 3, 1)


def test_amplitude_maps():
    x = np.linspace(-1, 1, 30)
    ols = model.fit_amplitude(0.4 + 2 * x, x, AmplitudeConfig(method="ols"))
    assert (ols.slope, ols.intercept) == pytest.approx((2, 0.4))
    assert model.fit_amplitude(9 * x, x, AmplitudeConfig(method="ols")).slope == 4.0
    assert model.fit_amplitude(x[:10], x[:10], AmplitudeConfig(method="ols")).method == "none"
    assert model.fit_amplitude(x, np.ones(30), AmplitudeConfig(method="variance")).method == "none"
    rng = np.random.default_rng(4)
    a = np.repeat([2.0, 6.0], 40)
    p = rng.normal(size=80) * np.where(a == 2, 0.5, 1.0)
    o = rng.normal(size=80)
    tier = model.fit_amplitude(o, p, AmplitudeConfig(method="variance", reference="max_proxy_nest"), a)
    assert tier.tier == 6 and tier.slope == pytest.approx(p[a == 6].std(ddof=1) / p.std(ddof=1))
    dynamic = model.fit_amplitude(o, p, AmplitudeConfig(method="dynamic_variance"), a, a)
    assert dynamic.method == "dynamic_variance" and dynamic.slopes[0] > dynamic.slopes[1]
    assert dynamic.apply(p, a).mean() == pytest.approx(o.mean())


def test_dynamic_slopes_by_their_formula():
    """Against sorted places dealt by hand: 60 distinct availabilities make three bins of twenty."""
    rng = np.random.default_rng(8)
    a, x = rng.permutation(60).astype(float), rng.normal(size=60)
    y = x * (1 + a / 20) + rng.normal(size=60)
    cfg = AmplitudeConfig(method="dynamic_variance", max_bins=3, bin_years=20, shrinkage_years=10)
    got = model.fit_amplitude(y, x, cfg, a, a)
    common = y.std(ddof=1) / x.std(ddof=1)
    order = np.argsort(a)
    for k, (knot, slope) in enumerate(zip(got.knots, got.slopes)):
        own = order[20 * k : 20 * k + 20]
        ratio = y[own].std(ddof=1) / x[own].std(ddof=1)
        assert knot == np.median(a[own]) and slope == pytest.approx(common ** (1 / 3) * ratio ** (2 / 3))
    assert len(got.knots) == 3
    # unknown availability has the typical slope; ties make one bin and so the plain map
    a[:5] = np.nan
    assert np.isfinite(model.fit_amplitude(y, x, cfg, a, a).apply(x, a)).all()
    tied = model.fit_amplitude(y, x, cfg, np.ones(60), np.ones(60))
    assert tied.method == "variance" and tied.slope == pytest.approx(common)


@settings(deadline=None, max_examples=30)
@given(st.integers(3, 40), st.integers(0, 10**6))
def test_banded_solver_is_numpys(n, seed):
    rng = np.random.default_rng(seed)
    d = np.zeros((3, n))
    d[0] = rng.uniform(0.1, 2, n)
    smooth.add_roughness(d, rng.uniform(0, 5))
    full = np.diag(d[0]) + sum(np.diag(d[k, : n - k], k) + np.diag(d[k, : n - k], -k) for k in (1, 2) if k < n)
    b = rng.normal(size=n)
    assert smooth.solve_banded(d[: min(3, n)], b) == pytest.approx(np.linalg.solve(full, b), rel=1e-6, abs=1e-8)


def dense_fusion(years, core, windows, weight, smoothness):
    """The increment by dense least squares."""
    seen, n = np.isfinite(core), len(years)
    scale = max(np.nanstd(core), 1e-6)
    rows, right = [], []
    for i in np.flatnonzero(seen):
        rows.append(np.eye(n)[i] / scale)
        right.append(0.0)
    for a, b, p in windows:
        at = np.flatnonzero((years >= a) & (years <= b) & seen)
        if len(at):
            row = np.zeros(n)
            row[at] = np.sqrt(weight) / scale / len(at)
            rows.append(row)
            right.append((p[0] - core[at].mean()) * np.sqrt(weight) / scale)
    for i in range(n - 2):
        row = np.zeros(n)
        row[i : i + 3] = np.sqrt(smoothness) * np.array([1, -2, 1])
        rows.append(row)
        right.append(0.0)
    return core + np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]


@pytest.mark.parametrize("smoothness", [0.0, 1.0])
def test_fusion_is_dense_least_squares(smoothness):
    rng = np.random.default_rng(5)
    years = np.arange(1900, 1990)
    core = rng.normal(size=90).cumsum()
    core[30:33] = np.nan
    windows = [(int(a), int(a) + 4, rng.normal(size=1)) for a in range(1900, 1990, 5)]
    got, audit = smooth.fuse(years, core, windows, 2.0, smoothness)
    assert len(audit) == 18
    want = dense_fusion(years, core, windows, 2.0, smoothness)
    ok = np.isfinite(core)
    assert got[ok, 0] == pytest.approx(want[ok], abs=1e-6)
    many, _ = smooth.fuse(years, np.column_stack([core, 2 * core]), [(a, b, np.r_[p, p]) for a, b, p in windows], 2.0, smoothness)
    assert many[ok, 0] == pytest.approx(got[ok, 0], abs=1e-9)


def test_lowpass_halves_the_declared_period_and_bridges_no_level():
    years = np.arange(0, 400)
    wave = np.sin(2 * np.pi * years / 20)
    _, low = smooth.lowpass(years, wave, 20.0)
    assert low[100:300].std() / wave[100:300].std() == pytest.approx(0.5, abs=0.05)
    _, slow = smooth.lowpass(years, np.sin(2 * np.pi * years / 200), 10.0)
    assert np.abs(slow - np.sin(2 * np.pi * years / 200)).max() < 0.02


def test_assimilation_moves_only_the_slow_part():
    years = np.arange(1800, 2000)
    truth = np.sin(2 * np.pi * years / 60)
    fast = np.random.default_rng(6).normal(scale=0.3, size=200)
    core = fast
    slow = [("p", years[::5].astype(float) + 2, np.array([truth[i : i + 5].mean() for i in range(0, 200, 5)]))]
    got, audit = smooth.assimilate(years, core, slow, years[100:], truth[100:], MultiresolutionConfig(enabled=True, constraint_weight=10))
    assert audit[0]["status"] == "used"
    assert np.corrcoef(got, truth)[0, 1] > np.corrcoef(core, truth)[0, 1] + 0.3
    nothing, why = smooth.assimilate(years, core, [("p", np.array([1.0]), np.array([1.0]))], years, truth, MultiresolutionConfig(enabled=True))
    assert (nothing == core).all() and why[0]["status"] == "excluded_no_calibration"


def test_spectrum_finds_peak_and_phase():
    years = np.arange(120)
    wave = np.sin(2 * np.pi * years / 20)
    got = skill.spectral(wave, 0.5 * wave, years, ((10.0, 30.0),))
    assert got["spectral_10_30y_observed_peak_period"] == pytest.approx(20)
    assert got["spectral_10_30y_amplitude_ratio"] == pytest.approx(0.5)
    assert got["spectral_10_30y_phase_similarity"] == pytest.approx(1)
    assert np.isnan(skill.spectral(wave[:20], wave[:20], years[:20], ((10.0, 30.0),))["spectral_10_30y_amplitude_ratio"])


def test_butterworth_passes_slow_and_stops_fast_waves():
    t = np.arange(300)
    assert smooth.butterworth(np.sin(2 * np.pi * t / 100), 10)[50:250] == pytest.approx(np.sin(2 * np.pi * t / 100)[50:250], abs=0.02)
    assert np.abs(smooth.butterworth(np.sin(2 * np.pi * t / 4), 20)[50:250]).max() < 0.02


def nest(seed=8, options=None):
    x, y = gappy(seed, 120, 6, 0.15)
    years = np.arange(1880, 2000)
    target = np.where(years >= 1900, y, np.nan)
    return x, years, list("abcdef"), target, years[years >= 1900], having(ReconstructionConfig(), {"ensemble.members": 40} | (options or {}))


def test_ensemble_shares_a_basis_and_beats_the_gate():
    x, years, names, y, train, cfg = nest()
    fit = model.fit_model(x, years, names, y, train, PCAConfig(), cfg)
    assert fit.members.shape == (120, 40) and fit.selected["passes"]
    again = model.fit_model(x, years, names, y, train, PCAConfig(), cfg)
    assert np.array_equal(fit.members, again.members, equal_nan=True)
    assert {r["stage"] for r in fit.selection} == {"structure", "amplitude"}
    with pytest.raises(RuntimeError, match="Kaiser"):
        model.fit_model(np.random.default_rng(0).normal(size=(120, 6)) + np.eye(120, 6) * 0, years, names, y, train, PCAConfig(kaiser_threshold=5.0), cfg)


def test_blocked_selection_and_gate():
    x, years, names, y, train, cfg = nest(options={"ensemble.members": 0, "regression.family": "auto", "regression.families": ("ridge", "pls", "ols")})
    fit = model.fit_model(x, years, names, y, train, PCAConfig(selection="kaiser_cv"), cfg)
    assert fit.members is None and fit.selected["passes"]
    noise = np.random.default_rng(1).normal(size=len(y))
    bad = model.fit_nest(x, years, names, {}, np.where(np.isfinite(y), noise, np.nan), train, PCAConfig(), cfg)
    assert not bad["accepted"] and bad["reason"] == "internal_ce_re"
    assert model.fit_nest(x[:, :1], years, ["a"], {}, y, train, PCAConfig(), cfg)["reason"] == "too_few_core_series"
    assert model.fit_nest(x, years, names, {}, y, train[:5], PCAConfig(), cfg)["reason"] == "insufficient_calibration"


def test_window_layer_is_fitted_and_fused():
    x, years, names, y, train, cfg = nest(options={"gates.ce": -5.0, "gates.re": -5.0, "nest.minimum_windows": 8})
    slow = np.array([np.nanmean(y[i : i + 3]) if np.isfinite(y[i : i + 3]).any() else 0.0 for i in range(0, 120, 3)])
    native = {"slow": (years[::3].astype(float) + 1, slow, 3.0)}
    got = model.fit_nest(x, years, names, native, y, train, PCAConfig(), cfg)
    assert got["accepted"] and got["layers"][0]["accepted"] and len(got["fusion"]) > 0
    assert got["members"].shape[0] == 120


def test_moving_blocks_are_runs():
    years = np.arange(100)
    sample = model.moving_blocks(years, 5, np.random.default_rng(1))
    assert len(sample) == 100 and (np.diff(sample.reshape(-1, 5), axis=1) == 1).all()


def test_replicates_refit_everything_but_the_selection():
    x, years, names, y, train, cfg = nest(options={"gates.ce": -5.0, "gates.re": -5.0, "ensemble.members": 6, "ensemble.scheme": "moving_block", "auto_tune": False, "nest.minimum_windows": 8})
    slow = np.array([np.nanmean(y[i : i + 3]) if np.isfinite(y[i : i + 3]).any() else 0.0 for i in range(0, 120, 3)])
    native = {"slow": (years[::3].astype(float) + 1, slow, 3.0)}
    got = model.fit_nest(x, years, names, native, y, train, PCAConfig(), cfg)
    fit = model.fit_model(x, years, names, y, train, PCAConfig(), cfg)
    layers, _ = model.window_layers(x, years, names, native, y, train, PCAConfig(), cfg)
    assert len(layers) == 1 and got["members"].shape == (120, 6)

    def plain(x, years, y, rows, fit):
        basis = linear.fit_basis(x[rows], years[rows], np.ones(len(rows), bool), PCAConfig())
        s = linear.scores(basis, x, years, fit.k, PCAConfig())
        line = linear.fit_regression(fit.regression, s[rows], y[rows], fit.alpha, cfg)
        raw = line.predict(s)
        slope = fit.amplitude_settings
        return model.fit_amplitude(y[rows], raw[rows], slope, basis.available(x)[rows], basis.effective(x)[rows]).apply(raw, basis.effective(x))

    for k, seed in enumerate(model.nest_seed(names, train, cfg.ensemble.seed).spawn(6)):
        rng = np.random.default_rng(seed)
        rows = model.moving_blocks(train, 5, rng) - 1880
        annual = plain(x, years, y, rows, fit)
        layer = layers[0]
        windows = model.moving_blocks(np.flatnonzero(layer["learn"]), 1, rng)
        coarse = plain(layer["x"], layer["starts"], layer["y"], windows, layer["fit"])
        means = [(int(a), int(b), np.array([v])) for a, b, seen, v in zip(layer["starts"], layer["ends"], layer["seen"], coarse) if seen and np.isfinite(v)]
        want, _ = smooth.fuse(years, annual, means, cfg.nest.constraint_weight, cfg.nest.smoothness)
        assert got["members"][:, k] == pytest.approx(want[:, 0])


@pytest.mark.parametrize("amplitude", [AmplitudeConfig(method="ols"), AmplitudeConfig(method="variance"), AmplitudeConfig(method="variance", reference="max_proxy_nest"), AmplitudeConfig(method="variance", minimum_overlap=1000), AmplitudeConfig(method="dynamic_variance")])
def test_all_runs_at_once_equal_one_by_one(amplitude):
    x, years, names, y, train, cfg = nest()
    rng = np.random.default_rng(3)
    s = rng.normal(size=(120, 3))
    usable = np.flatnonzero(np.isfinite(y))
    learn = np.array([rng.permutation(usable)[:60] for _ in range(7)])
    intercepts, betas = model._all_lines(s, y, learn)
    raw = s @ betas.T + intercepts
    for run, t in enumerate(learn):
        assert raw[:, run] == pytest.approx(linear.fit_regression("ols", s[t], y[t], 0.0, cfg).predict(s))
    available, effective = rng.integers(2, 7, 120).astype(float), rng.random(120)
    got = model._all_amplitudes(raw, y, learn, amplitude, available, effective)
    for run, t in enumerate(learn):
        assert got[:, run] == pytest.approx(model.fit_amplitude(y[t], raw[t, run], amplitude, available[t], effective[t]).apply(raw[:, run], effective))
    assert model._all_lines(np.ones((120, 2)), y, learn) is None


def test_bucket_means_use_a_boundary_sample_once():
    got = model.bucket_means(np.array([1902.5]), np.array([7.0]), 1900, 1908, 3)
    assert np.isnan(got[0]) and got[1] == 7 and np.isnan(got[2])


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5, 8])
def test_zero_phase_filter_by_its_definition(order):
    """Against one high-order recurrence per direction, begun by a long past that is constant."""
    rng = np.random.default_rng(order)
    x, period, m = np.cumsum(rng.normal(size=90)), 9.0, 3 * (order + 1)
    w = np.tan(np.pi / period)
    poles = w * np.exp(1j * np.pi * (2 * np.arange(order) + 1 + order) / (2 * order))  # s, in the left half plane
    a = np.poly((1 + poles) / (1 - poles)).real
    b = np.poly(-np.ones(order))
    b = b * a.sum() / b.sum()

    def once(v):
        past = 4000
        v = np.concatenate([np.full(past, v[0]), v])
        y = np.full(len(v), v[0])
        for k in range(order, len(v)):
            y[k] = sum(b[i] * v[k - i] for i in range(order + 1)) - sum(a[i] * y[k - i] for i in range(1, order + 1))
        return y[past:]

    longer = np.concatenate([2 * x[0] - x[m:0:-1], x, 2 * x[-1] - x[-2 : -m - 2 : -1]])
    want = once(once(longer)[::-1])[::-1][m : m + len(x)]
    assert np.abs(smooth.butterworth(x, period, order) - want).max() < (1e-8 if order < 8 else 1e-5)
    assert smooth.butterworth(np.full(60, 3.5), period, order) == pytest.approx(np.full(60, 3.5), abs=1e-12)


def test_zero_phase_filter_gain_and_shortest_series():
    t = np.arange(2000)
    for period in (6.0, 10.0, 25.0):
        gain = 1 / (1 + (np.tan(np.pi / period) / np.tan(np.pi / 10)) ** 8)
        wave = np.cos(2 * np.pi * t / period)
        assert smooth.butterworth(wave, 10.0, 4)[500:1500] == pytest.approx(gain * wave[500:1500], abs=1e-9)
    assert len(smooth.butterworth(np.arange(16.0), 10.0, 4)) == 16
    for n in (11, 15):
        with pytest.raises(ValueError):
            smooth.butterworth(np.arange(float(n)), 10.0, 4)


def test_slow_samples_are_told():
    years = np.arange(1800, 2001)
    truth = np.sin(years / 15.0)
    core = truth + 0.3
    times = years[::10].astype(float) + 4.5
    values = 2 * np.array([truth[i : i + 10].mean() for i in range(0, 201, 10)]) + 1
    rows: list[dict] = []
    cfg = MultiresolutionConfig(enabled=True, constraint_weight=4)
    got, audit = smooth.assimilate(years, core, [("a", times, values), ("b", times[:1], values[:1])], years[100:], truth[100:], cfg, rows)
    assert [a["status"] for a in audit] == ["used", "excluded_no_calibration"]
    one = audit[0]
    assert one["constraint_count"] == len(rows) and one["minimum_support_years"] <= one["median_support_years"] <= one["maximum_support_years"]
    for r in rows:
        assert r["pid"] == "a" and r["mapped_lowpass_value"] == pytest.approx(one["psm_intercept"] + one["psm_slope"] * r["proxy_value"])
        assert r["innovation"] == pytest.approx(r["mapped_lowpass_value"] - r["core_lowpass_window_mean"])
        assert r["support_end"] - r["support_start"] == pytest.approx(r["support_width_years"]) and r["annual_state_count"] == r["annual_state_end"] - r["annual_state_start"] + 1
        assert r["constraint_weight"] == pytest.approx((4 / one["psm_residual_variance"]) ** 0.5)
    assert smooth.assimilate(years, core, [("a", times, values)], years[100:], truth[100:], cfg)[0] == pytest.approx(got, nan_ok=True)
