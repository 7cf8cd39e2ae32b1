"""Relational operators: golden cases by hand, and properties against plain Python."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varve.config import FilterConfig, NestConfig, PipelineConfig, ReconstructionConfig, ScreeningConfig, WeightConfig, from_json, having, to_json
from varve.functions import stats
from varve.operators import amplitude, dedup, filters, graph, nests, screening, temporal, validation, weights
from varve.sources import series

RELAXED = settings(deadline=None, max_examples=8, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_season_belongs_to_the_year_it_ends_in(spark):
    obs = spark.createDataFrame([("a", 1999 + (m - 1) / 12 + (0 if m == 12 else 1) + 0.01, float(m)) for m in (12, 1, 2)] + [("a", 2000 + (m - 1) / 12 + (0 if m == 12 else 1) + 0.01, float(m)) for m in (12, 1, 2)], "pid string, time double, value double")
    assert rows(temporal.annualize(obs, (12, 1, 2), "end", 1.0), "year", "value") == [(2000, 5.0), (2001, 5.0)]
    assert rows(temporal.annualize(obs, (12, 1, 2), "start", 1.0), "year", "value") == [(1999, 5.0), (2000, 5.0)]
    with pytest.raises(ValueError):
        temporal.season_year(F.lit(1), F.lit(1), (1,), "middle")


def test_monthly_table(spark):
    wide = spark.createDataFrame([(2000, "1", 3.0, 5.0), (2001, "2", 4.0, 6.0)], "Year int, Jan string, February double, MAR double")
    assert rows(series.load_observations(wide, months=(1, 2, 3)), "year", "y") == [(2000, 3.0), (2001, 4.0)]
    one = spark.createDataFrame([(1900.2, 1.0), (1900.9, 3.0), (None, 2.0), (1901.0, None)], "Year double, v double")
    assert rows(series.load_observations(one), "year", "y") == [(1900, 2.0)]
    with pytest.raises(ValueError, match="value column"):
        series.load_observations(one.withColumn("w", F.lit(1)))


def test_sources(spark):
    nested = spark.createDataFrame([("a", "[1900, 1901, nan]", [1.0, 2.0, 3.0], "AD", "Wood", "7.5"), ("b", "(50, 40)", [1.0, 2.0], "yr BP", None, "x"), ("c", "[]", [], None, None, None)], "datasetId string, year string, paleoData_values array<double>, yearUnits string, archiveType string, geo_meanLat string")
    got = series.load_series(nested)
    assert rows(got.observations, "pid", "time", "value") == [("a", 1900.0, 1.0), ("a", 1901.0, 2.0), ("b", 1900.0, 1.0), ("b", 1910.0, 2.0)]
    assert rows(got.records, "pid", "archive", "lat") == [("a", "Wood", 7.5), ("b", "unknown", None)]
    assert rows(got.rejects, "pid") == [("c",)]
    bad = spark.createDataFrame([("a", "[1, 2]", [1.0])], "datasetId string, year string, paleoData_values array<double>")
    with pytest.raises(Exception, match="lengths differ"):
        series.load_series(bad).observations.collect()
    compact = spark.createDataFrame([("p", 1.0, 2.0, "coral.d18O"), ("p", 1.0, 4.0, "coral.d18O")], "pid string, time double, value double, ptype string")
    got = series.load_series(compact)
    assert rows(got.observations, "value") == [(3.0,)] and rows(got.records, "archive", "proxy") == [("coral", "coral.d18O")]
    with pytest.raises(ValueError):
        series.load_series(spark.range(1))


def test_series_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Year,Value\n1900,1\n1901,x\n")
    assert rows(series.load_series_files(spark, str(tmp_path)), "pid", "time", "value") == [("one", 1900.0, 1.0)]


def test_gap_fill_keeps_long_gaps_and_ends(spark):
    years = [1900, 1901, 1904, 1905, 1910, 1911]
    annual = spark.createDataFrame([("w", y, float(y - 1900 - (y > 1901))) for y in years], "pid string, year int, value double")
    filled = temporal.fill_short_gaps(temporal.dense_matrix(annual, 1898, 1912), 2)
    got = {r.year: r.value for r in filled.where("is_interpolated").collect()}
    assert got == {1902: pytest.approx(1 + 2 / 3), 1903: pytest.approx(1 + 4 / 3)}
    assert rows(temporal.gap_audit(filled), "native_years", "interpolated_years") == [(6, 2)]
    none = temporal.fill_short_gaps(temporal.dense_matrix(annual, 1898, 1912), 2, F.lit(False))
    assert none.where("is_interpolated").count() == 0


def test_windows(spark):
    obs = spark.createDataFrame([("a", 1902.5, 7.0)], "pid string, time double, value double")
    assert rows(temporal.native_window_means(obs, 1900, 1908, 3), "window_id") == [(1903,)]
    assert rows(temporal.window_table(spark, 1900, 1933, 5), "window_id", "window_end", "window_year_count")[-1] == (1930, 1933, 4)


def test_zscores(spark):
    annual = spark.createDataFrame([("a", 1900 + k, float(k)) for k in range(11)] + [("flat", 1905, 1.0), ("flat", 1906, 1.0)], "pid string, year int, value double")
    allowed = spark.createDataFrame([(1900 + k,) for k in range(8)], "year int")
    z = temporal.reference_zscore(annual, 1905, 1910, allowed)
    assert rows(z.where("pid = 'a' and year = 1906"), "value", "reference_mean", "reference_n") == [(0.0, 6.0, 3)]
    assert rows(z.where("pid = 'flat'"), "value") == [(None,), (None,)]
    native = spark.createDataFrame([("a", 1900.0 + 3 * k, 10.0 + 3 * k) for k in range(4)], "pid string, time double, value double")
    assert [r.value for r in temporal.native_zscore(native, 1900, 1906).orderBy("time").collect()] == [-1, 0, 1, 2]


@RELAXED
@given(st.lists(st.integers(0, 30), min_size=1, max_size=20, unique=True))
def test_longest_run(spark, years):
    years = sorted(years)
    best, at = (0, 0), 0
    for k in range(len(years)):
        if k and years[k] != years[k - 1] + 1:
            at = k
        if k - at + 1 > best[0]:
            best = (k - at + 1, years[at])
    got = temporal.longest_run(spark.createDataFrame([(y, 1.0) for y in years], "year int, value double")).first()
    assert (got["years"], got["start"]) == best


def holm(p):
    order = sorted(range(len(p)), key=lambda k: p[k])
    out, top = [0.0] * len(p), 0.0
    for i, k in enumerate(order):
        top = max(top, (len(p) - i) * p[k])
        out[k] = min(1.0, top)
    return out


def bh(p):
    order = sorted(range(len(p)), key=lambda k: p[k])
    out, low = [0.0] * len(p), 1.0
    for i in range(len(p) - 1, -1, -1):
        low = min(low, p[order[i]] * len(p) / (i + 1))
        out[order[i]] = low
    return out


@RELAXED
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_adjusted_p(spark, p):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(p)] + [(99, None)], "k int, p double")
    got = stats.benjamini_hochberg(stats.holm(df, "p", "h", (), ["k"]), "p", "b", (), ["k"]).orderBy("k").collect()
    assert [r.h for r in got[:-1]] == pytest.approx(holm(p)) and [r.b for r in got[:-1]] == pytest.approx(bh(p))
    assert got[-1].h is None and got[-1].b is None


def test_golden_adjusted_p(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "k int, p double")
    assert [r.b for r in stats.benjamini_hochberg(df, "p", "b", (), ["k"]).orderBy("k").collect()] == [0.03, 0.04, 0.04, None]


def test_effective_correlation_guards(spark):
    flat = spark.createDataFrame([("a", k, 1.0, float(k)) for k in range(30)] + [("b", 1, 1.0, 2.0), ("b", 2, 2.0, 1.0)], "pid string, year int, x double, y double")
    got = {r.pid: r for r in screening.effective_correlation(flat).collect()}
    assert got["a"].r is None and got["a"].p is None and got["b"].r is None and got["b"].n_eff == 2
    line = spark.createDataFrame([("c", k, float(k % 5), float((k * 3) % 5)) for k in range(40)], "pid string, year int, x double, y double")
    one = screening.effective_correlation(line).first()
    assert -1 <= one.r <= 1 and 3 <= one.n_eff <= 40 and 0 <= one.p <= 1


def test_screening_selects_the_series_that_follows(spark):
    target = spark.createDataFrame([(1900 + k, math.sin(k * 1.7)) for k in range(80)], "year int, y double")
    obs = [("good", 1900.0 + k, math.sin(k * 1.7) + 0.1 * math.cos(k * 5.1)) for k in range(80)] + [("bad", 1900.0 + k, math.cos(k * 2.9)) for k in range(80)] + [("few", 1900.0 + k, math.sin(k * 1.7)) for k in range(10)]
    records = spark.createDataFrame([(p, "Wood", "w", 0.0, 0.0) for p in ("good", "bad", "few")], "pid string, archive string, proxy string, lat double, lon double")
    table = screening.screen(spark.createDataFrame(obs, "pid string, time double, value double"), records, target, ScreeningConfig())
    got = {r.pid: r for r in table.collect()}
    assert got["good"].selected and not got["bad"].selected and not got["few"].selected
    assert table.first().pid == "good" and got["good"].seasons_tested == 1


def test_filters(spark):
    rec = spark.createDataFrame([("a", 2200.0, 1.0, 10.0, 170.0, "Wood", "w"), ("b", 1990.0, None, None, 20.0, "ice", "W "), ("c", 1990.0, 1.0, 5.0, -170.0, " WOOD ", "x")], "pid string, end double, resolution double, lat double, lon double, archive string, proxy string").withColumn("metadata", F.create_map().cast("map<string,string>"))
    cfg = FilterConfig(latitude=(0, 20), longitude=(160, 200), archives=("wood",), maximum_resolution_years=5)
    assert rows(filters.filter_decisions(rec, cfg), "pid", "reasons", "included") == [("a", "implausible_end_year", False), ("b", "resolution|latitude|longitude|archive", False), ("c", "", True)]
    assert rows(filters.filter_records(rec, cfg), "pid") == [("c",)]
    only = rec.where(filters.in_longitudes(F.col("lon"), -180, 180))
    assert only.count() == 0  # both bounds are -180
    gate = spark.createDataFrame([(0.1, 0.2), (0.2, 0.2), (None, 0.2), (float("nan"), 1.0)], "ce double, re double")
    assert [r[0] for r in gate.select(filters.passes_gate(F.col("ce"), F.col("re"), 0.1, 0.1)).collect()] == [False, True, False, False]
    assert [r[0] for r in gate.select(filters.passes_gate(F.col("ce"), F.col("re"), 0.1, 0.1, "ge")).collect()] == [True, True, False, False]


def test_five_golden_nests(spark):
    bounds = spark.createDataFrame([("a", 40, 2005), ("b", 80, 1990), ("c", 500, 2010), ("d", 1800, 2000)], "pid string, start int, end int")
    got = [(r.start, r.end, "".join(r.pids)) for r in nests.coverage_nests(bounds).orderBy("nest_id").collect()]
    assert got == brute_nests({"a": (40, 2005), "b": (80, 1990), "c": (500, 2010), "d": (1800, 2000)}, NestConfig())
    assert len(got) == 5 and got[0][0] == 80


def brute_nests(bounds, cfg):
    starts = sorted({s for s, _ in bounds.values() if s >= cfg.minimum_start})
    early = [s for s, _ in bounds.values() if s < cfg.minimum_start]
    starts = ([max(early)] if early else []) + starts
    best = {}
    for s in starts:
        for e in sorted({e for _, e in bounds.values()}):
            net = tuple(sorted(p for p, (a, b) in bounds.items() if a <= s and b >= e))
            if e - s >= cfg.span and len(net) >= cfg.minimum_members and (net not in best or e - s > best[net][1] - best[net][0]):
                best[net] = (s, e)
    return [(s, e, "".join(n)) for s, e, n in sorted((s, e, n) for n, (s, e) in best.items())]


@RELAXED
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 60), st.integers(100, 160)), min_size=1))
def test_nests_equal_brute_force(spark, bounds):
    cfg = NestConfig(span=60, minimum_start=20)
    df = spark.createDataFrame([(p, *b) for p, b in bounds.items()], "pid string, start int, end int")
    assert [(r.start, r.end, "".join(r.pids)) for r in nests.coverage_nests(df, cfg).orderBy("nest_id").collect()] == brute_nests(bounds, cfg)


def test_pool_is_not_a_median_of_medians(spark):
    members = spark.createDataFrame([("x", 1900, [0.0, 1.0, 100.0]), ("y", 1900, [2.0, 3.0, 4.0]), ("y", 1901, [float("nan"), 5.0])], "nest_id string, year int, runs array<double>")
    got = {r.year: r for r in nests.pool_members(members).collect()}
    assert got[1900].median == 2.5 and got[1900].ensemble_n == 6 and got[1901].ensemble_n == 1
    dense = members.withColumns({"core_count": F.when(F.col("nest_id") == "x", 5).otherwise(2), "start": F.lit(0), "end": F.lit(1)})
    assert {r.year: r.median for r in nests.pool_densest(dense).collect()} == {1900: 1.0, 1901: 5.0}


def facts(spark, pids, quality=None, urls=()):
    return spark.createDataFrame([(p, k, (quality or {}).get(p, 3), p in urls, "wood", "w", "v", 1.0, 2.0) for k, p in enumerate(pids)], "pid string, seq long, quality int, has_url boolean, archive string, proxy string, variable string, lat double, lon double")


def test_exact_and_near_duplicates(spark):
    base = [1.23456789, 2.3456789, 3.456789, 9.87654321]
    data = {"less": [4.0, 5.0, 6.0], "more": [4.0, 5.0, 6.0], "n1": base, "n2": [round(v, 4) for v in base], "far": [v + 1 for v in base]}
    obs = spark.createDataFrame([(p, float(k), v) for p, vs in data.items() for k, v in enumerate(vs)], "pid string, time double, value double")
    kept, dropped, groups = dedup.deduplicate(facts(spark, list(data), urls=("more",)), obs)
    assert [r.pid for r in kept.collect()] == ["more", "n1", "far"]
    assert rows(dropped, "pid", "keep_pid", "group_id", "reason") == [("less", "more", "exact_0001", "exact"), ("n2", "n1", "near_0002", "rounding-equivalent")]
    other = facts(spark, list(data)).withColumn("lat", F.col("seq").cast("double"))
    assert dedup.deduplicate(other, obs)[1].count() == 1
    assert dedup.deduplicate(facts(spark, list(data)), obs, near=False)[1].count() == 1


def test_redundancy(spark):
    wave = [math.sin(k * 1.3) for k in range(40)]
    data = {"a": wave, "b": [2 * v + 1 for v in wave], "c": [math.cos(k * 2.1) for k in range(40)], "d": wave}
    annual = spark.createDataFrame([(p, k, v) for p, vs in data.items() for k, v in enumerate(vs)], "pid string, year int, value double")
    records = spark.createDataFrame([("a", "w", "x", 10.0, 179.5, {"error_sd": "1"}), ("b", "W", "x", 10.0, -179.9, {}), ("c", "w", "x", 10.0, 179.6, {}), ("d", "w", "x", 50.0, 0.0, {})], "pid string, archive string, proxy string, lat double, lon double, metadata map<string,string>")
    got = {r.pid: r for r in weights.series_weights(records, annual, WeightConfig(enabled=True)).collect()}
    assert got["a"].redundancy_group == got["b"].redundancy_group and got["a"].redundancy_weight == 0.5
    assert got["c"].weight == 1 and got["d"].weight == 1 and got["a"].weight < 0.5 and got["a"].pair_links == 1
    off = {r.pid: r for r in weights.series_weights(records, annual).collect()}
    assert off["a"].weight == 1 and off["a"].error_weight < 1


def test_components(spark):
    nodes = spark.createDataFrame([(chr(97 + k),) for k in range(8)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("f", "g")], "a string, b string")
    assert dict(rows(graph.component_labels(nodes, edges), "node", "label")) == dict(zip("abcdefgh", "aaaaeffh"))


def test_folds(spark):
    years = spark.createDataFrame([(y,) for y in range(1900, 2001)], "year int")
    count = lambda df: rows(df.groupBy("fold").count(), "fold", "count")
    assert count(validation.contiguous_folds(years, 34)) == [(0, 34), (1, 34), (2, 33)]
    assert count(validation.contiguous_folds(years, 20)) == [(0, 20), (1, 20), (2, 20), (3, 20), (4, 21)]
    edge = validation.edge_folds(years, 1 / 3).groupBy("fold").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    assert rows(edge, "a", "b") == [(1900, 1933), (1967, 2000)]
    assert validation.contiguous_folds(years.limit(10), 3).count() == 0
    folds = validation.contiguous_folds(years, 34)
    assert count(validation.training_years(years, folds)) == [(0, 67), (1, 67), (2, 68)]


def test_amplitude_tables(spark):
    df = spark.createDataFrame([("a", k, 0.4 + 2 * k / 10, k / 10) for k in range(30)], "pid string, year int, observed double, predicted double")
    got = amplitude.affine_maps(df, ["pid"], "ols").first()
    assert (got.slope, got.intercept) == pytest.approx((2, 0.4))
    few = amplitude.affine_maps(df.limit(5), ["pid"], "ols").first()
    assert (few.slope, few.intercept) == (1, 0)
    knots = amplitude.apply_knots(spark.createDataFrame([(0.0, 3.0), (5.0, 3.0), (9.0, 3.0)], "availability double, value double"), [1, 9], [1.0, 3.0], 1.0, 10.0)
    assert [r.value for r in knots.collect()] == [12.0, 14.0, 16.0]
    mapped = amplitude.apply_affine(df.select("pid", F.col("predicted").alias("value")), amplitude.affine_maps(df, ["pid"], "ols"), ["pid"])
    assert mapped.agg(F.max("value")).first()[0] == pytest.approx(6.2)


def test_memberships_and_comparison(spark):
    pids = spark.createDataFrame([(p,) for p in "abcde"], "pid string")
    assert validation.leave_one_out(pids).count() == 20
    assert validation.random_deletion(pids, 2, 0.2).count() == 8
    a = spark.createDataFrame([(k, float(k)) for k in range(5)], "year int, value double")
    assert validation.compare(a, a).first().largest == 0
    assert validation.combine_first(a.limit(2), a).count() == 5
    assert rows(validation.summarize(spark.createDataFrame([(1.0,), (3.0,), (None,)], "m double"), ["m"]), "metric", "n", "median") == [("m", 2, 2.0)]


def test_config():
    with pytest.raises(ValueError):
        ScreeningConfig(native_window_bins=(3, 2))
    with pytest.raises(ValueError):
        having(ReconstructionConfig(), {"regression.family": "magic"})
    with pytest.raises(ValueError):
        NestConfig(bins=(2, 20))
    got = from_json({"screening": {"period": [1900, 2000], "archive_max_counts": [["Wood", 3]]}, "reconstruction": {"n_bootstrap": 10, "amplitude": {"method": "ols"}}, "output": {"figure_format": "png"}})
    assert got.screening.period == (1900, 2000) and got.reconstruction.amplitude.method == "ols" and got.screening.archive_max_counts == (("Wood", 3),)
    assert got.reconstruction.ensemble.members == 10 and from_json(to_json(got)) == got
    with pytest.raises(ValueError, match="no settings"):
        from_json({"screen": {"period": None}})
    with pytest.raises(ValueError, match="has no"):
        having(PipelineConfig(), {"screen.period": None})


def test_student_tail_in_the_jvm(spark):
    """Two-sided tails of Student's distribution, closed forms for 1, 2 and 4 degrees of freedom; any others against the numpy form."""
    cases = [(float(t), float(n)) for t in (0, 1e-6, 0.01, 0.5, 1, 2.5, 12, 1e5) for n in (1, 1.5, 2, 3.3, 4, 10, 57.2, 300, 5000)]
    df = spark.createDataFrame([*cases, (None, 3.0), (1.0, None), (float("nan"), 2.0), (float("inf"), 2.0), (2.0, 0.2)], "t double, n double")
    got = {(r.t, r.n): r.p for r in df.select("t", "n", stats.student_p(F.col("t"), F.col("n")).alias("p")).collect()}
    closed = {1.0: lambda t: 1 - 2 / math.pi * math.atan(t), 2.0: lambda t: 1 - t / math.sqrt(2 + t * t), 4.0: lambda t: 1 - (t / math.sqrt(4 + t * t)) * (1 + 2 / (4 + t * t))}
    for t, n in cases:
        want = closed[n](t) if n in closed else float(stats.two_sided_p(np.array([t]), np.array([n]))[0])
        assert got[t, n] == pytest.approx(want, abs=1e-6 if n not in closed and t == 1e-6 else 1e-9), (t, n)
    assert got[12.0, 57.2] == pytest.approx(float(stats.two_sided_p(np.array([12.0]), np.array([57.2]))[0]), rel=1e-8)
    assert got[None, 3.0] is None and got[1.0, None] is None and got[float("inf"), 2.0] is None and got[2.0, 0.2] == pytest.approx(closed[1.0](2.0))


@pytest.mark.parametrize("radius", [30.0, 400.0, 2500.0, 9000.0, 19000.0])
def test_cells_on_the_sphere_find_all_near_pairs(spark, radius):
    """Against all pairs, at the date line, at both poles and in any convention of longitudes; few candidates are far."""
    rng = np.random.default_rng(int(radius))
    lat = np.degrees(np.arcsin(rng.uniform(-1, 1, 250)))
    lon = rng.uniform(-180, 360, 250)
    spots = [(90.0, 0.0), (90.0, 77.0), (-90.0, 10.0), (89.9, 190.0), (-89.95, -3.0), (0.0, 180.0), (0.0, -180.0), (0.1, 179.9), (0.05, -179.95), (60.0, 359.99), (60.0, 0.01), (None, 5.0), (3.0, None)]
    near = [(float(a) + d, float(o) + e) for a, o in zip(lat[:40], lon[:40]) if abs(a) < 85 for d, e in ((0.1, 0.1), (2.0, -3.0))]
    rows = [(f"p{k:03d}", a, o) for k, (a, o) in enumerate([*zip(lat.tolist(), lon.tolist()), *near, *spots])]
    df = spark.createDataFrame(rows, "pid string, lat double, lon double")
    a, b = (df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns]) for side in "ab")
    candidates = weights.cell_pairs(a, b, radius, F.col("pid_a") < F.col("pid_b")).select("pid_a", "pid_b", stats.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("km")).collect()
    got = {(r.pid_a, r.pid_b) for r in candidates if r.km <= radius}
    place = {p: (math.radians(y), math.radians(x)) for p, y, x in rows if y is not None and x is not None}

    def km(p, q):
        (y1, x1), (y2, x2) = place[p], place[q]
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))

    want = {(p, q) for p in place for q in place if p < q and km(p, q) <= radius}
    assert {(p, q) for p, q in want if abs(km(p, q) - radius) > 1e-6} <= got and all(km(*x) <= radius + 1e-6 for x in got)
    assert len(candidates) == len({(r.pid_a, r.pid_b) for r in candidates})
    everything = len(place) * (len(place) - 1) / 2
    if radius <= 2500:  # some nine cells of the radius' size, more beside the poles
        assert len(candidates) < everything * min(1.0, 0.02 + 12 * (radius / 20000) ** 2)


def test_nests_of_each_run_stand_apart(spark):
    one = [("a", 0, 100), ("b", 10, 90), ("c", 10, 100), ("d", 30, 80)]
    rows = [("x", *r) for r in one] + [("y", *r) for r in one[:2]]
    df = spark.createDataFrame(rows, "run string, pid string, start int, end int")
    cfg = NestConfig(span=20, minimum_start=0)
    told = lambda d, *keys: sorted((*[r[k] for k in keys], r.nest_id, r.start, r.end, "".join(r.pids)) for r in d.collect())
    both = told(nests.coverage_nests(df, cfg, 5, 95, ["run"]), "run")
    apart = [(run, *r) for run in "xy" for r in told(nests.coverage_nests(df.where(F.col("run") == run).drop("run"), cfg, 5, 95))]
    assert both == apart and ("y", "nest_001", 10, 90, "ab") in both


def test_availability_by_differences(spark):
    filled = spark.createDataFrame([("a", 0, 1.0, True, False), ("a", 1, 2.0, False, True), ("a", 2, None, False, False), ("a", 3, None, False, False), ("b", 0, 1.0, True, False), ("b", 1, None, False, False), ("b", 2, 5.0, True, False), ("b", 3, None, False, False), ("z", 0, 1.0, True, False)], "pid string, year int, value double, is_native boolean, is_interpolated boolean")
    member = spark.createDataFrame([("r", "a"), ("r", "b"), ("q", "b")], "run string, pid string")
    model = spark.createDataFrame([("r", "a", 0.5), ("q", "b", 1.0)], "run string, pid string, weight double")
    low = spark.createDataFrame([("r", "s")], "run string, pid string")
    obs = spark.createDataFrame([("s", 2.0, 1.0), ("s", 3.0, 1.0), ("t", 0.0, 1.0), ("t", 3.0, 1.0)], "pid string, time double, value double")
    got = {(r.run, r.year): tuple(r)[2:] for r in temporal.labelled_availability(filled, member, model, low, obs, 1).collect()}
    assert got == {
        ("r", 0): (2, 1, 1, 0, False, 0.5, 0, "annual_core"), ("r", 1): (1, 1, 0, 1, True, 0.5, 0, "annual_core"), ("r", 2): (1, 0, 0, 0, False, 0.0, 1, "low_frequency_only"), ("r", 3): (0, 0, 0, 0, False, 0.0, 1, "low_frequency_only"),
        ("q", 0): (1, 1, 1, 0, False, 1.0, 0, "annual_core"), ("q", 1): (0, 0, 0, 0, False, 0.0, 0, "unconstrained"), ("q", 2): (1, 1, 1, 0, False, 1.0, 0, "annual_core"), ("q", 3): (0, 0, 0, 0, False, 0.0, 0, "unconstrained"),
    }
    assert {r.pid: (r.lo, r.hi) for r in temporal.covered_years(spark.createDataFrame([("s", 1.0, 0.0), ("s", 2.0, 0.0), ("u", 5.0, 0.0)], "pid string, time double, value double")).collect()} == {"s": (1, 2), "u": (5, 5)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-60, 60)), max_size=14))
def test_support_counts_by_differences(spark, samples):
    df = spark.createDataFrame([(p, t / 2.0, 0.0) for p, t in sorted(set(samples))], "pid string, time double, value double")
    got = {r.year: r.support for r in temporal.support_counts(df, -20, 20).collect()}
    spans = [(r.pid, r.time - r.width / 2, r.time + r.width / 2) for r in temporal.support_widths(df).collect()]
    assert got == {y: len({p for p, a, b in spans if a <= y < b}) for y in range(-20, 21)}
