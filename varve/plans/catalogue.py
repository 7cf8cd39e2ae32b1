"""All queries over the supplied tables, with the SQL that they are checked against.

Each query applies operators of the library to whole tables. The SQL is written for DuckDB; figures
are rounded to six places on both sides, as sums in another order differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FilterConfig, NestConfig, PCAConfig, ReconstructionConfig, ScreeningConfig, WeightConfig, having
from ..functions import stats
from ..operators import amplitude, dedup, filters, nests, screening, temporal, validation, weights
from ..sources import series, supplied

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The last week (as a year) of windows that hold all of the supplied sales, which end in week 357.
WEEKS = 359
WEEK = "floor(date_diff('day', DATE '1995-01-01', day) / 7.0)"
#: Views that the SQL of several queries begins with.
VIEWS = {
    "sales": "SELECT p_brand AS pid, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey",
    "weekly": f"SELECT pid, CAST({WEEK} AS DOUBLE) AS time, avg(value) AS value FROM sales GROUP BY 1, 2",
    "annual": "SELECT pid, CAST(floor(time + 1e-7) AS INTEGER) AS year, avg(value) AS value FROM weekly GROUP BY 1, 2",
    "target": f"SELECT CAST({WEEK} AS INTEGER) AS year, avg(value) AS y FROM sales GROUP BY 1",
    "calendar": "SELECT pid, year(day) + (dayofyear(day) - 1) / 366.0 AS time, avg(value) AS value FROM sales GROUP BY 1, 2",
    "res": "SELECT pid, median(gap) AS resolution FROM (SELECT pid, time - lag(time) OVER (PARTITION BY pid ORDER BY time) AS gap FROM weekly) GROUP BY pid",
    "records": "SELECT DISTINCT p_brand AS pid, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS k FROM part",
    "places": "SELECT pid, k, CAST(k * 3 - 90 AS DOUBLE) AS lat, CAST((k * 17) % 360 AS DOUBLE) AS lon, ['Wood', 'Coral', 'GlacierIce', 'Speleothem'][k % 4 + 1] AS archive, 'set' || (k % 5) AS source, CASE WHEN k % 3 = 0 THEN 2.5 END AS error FROM records",
    "events_by": "SELECT 'u' || (user_id % 20) AS pid, CAST(floor((epoch(ts) - epoch(ts) % 1 - 1704067200) / 3600.0) AS DOUBLE) AS time, avg(value) AS value FROM events GROUP BY 1, 2",
    "gappy": f"SELECT 's' || l_suppkey AS pid, CAST({WEEK.replace('day)', 'CAST(l_shipdate AS DATE))')} AS INTEGER) AS year, avg(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2",
    "by_user": "SELECT 'u' || user_id AS pid, CAST(floor((epoch(ts) - epoch(ts) % 1 - 1704067200) / 3600.0) AS DOUBLE) AS time, avg(value) AS value FROM events GROUP BY 1, 2",
    "span": "SELECT min(year) AS lo, max(year) AS hi FROM annual",
    "pairs": "SELECT pid, annual.year, value AS x, y FROM annual JOIN target ON annual.year = target.year",
    "split": "SELECT pid, year, x, y, md5(pid || ':' || year) AS place FROM pairs",
    "held": "SELECT pid, year, x, y, row_number() OVER (PARTITION BY pid ORDER BY place, year) <= ceil(count(*) OVER (PARTITION BY pid) / 3.0) AS held FROM split",
    "model": "SELECT pid, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, avg(y) AS train_mean FROM held WHERE NOT held GROUP BY pid",
    "member": "SELECT h.pid AS nest_id, year, held, y, intercept + slope * x AS value, train_mean FROM held h JOIN model m ON h.pid = m.pid",
}
NEEDS = {"weekly": ["sales"], "annual": ["weekly"], "target": ["sales"], "calendar": ["sales"], "res": ["weekly"], "places": ["records"], "span": ["annual"], "pairs": ["annual", "target"], "split": ["pairs"], "held": ["split"], "model": ["held"], "member": ["held", "model"]}


def _with(sql: str, names: tuple[str, ...]) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    sql = sql.strip()
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if not views:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{views}, {sql[len(start):]}"
    return f"WITH {views} {sql}"


def query(sql: str | None = None, *views: str):
    """Register a query; with SQL, it is checked value by value."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = _with(sql, views)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import modelling  # noqa: F401  registers the queries of the kernels

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def annual_of(spark: SparkSession, d: str) -> DataFrame:
    return supplied.weekly(spark, d).groupBy("pid", F.floor(F.col("time") + 1e-7).cast("int").alias("year")).agg(F.avg("value").alias("value"))


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    return annual_of(spark, d).join(supplied.weekly_target(spark, d), "year").select("pid", "year", F.col("value").alias("x"), "y")


def gappy_of(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' weeks, of which many lack a sale."""
    return supplied.supplier_weeks(spark, d).withColumnRenamed("time", "year").withColumn("year", F.col("year").cast("int"))


# sources and the data model


@query("SELECT pid, time, round(value, 6) AS value FROM weekly", "weekly")
def series_observations(spark, d):
    return temporal.clean_observations(supplied.weekly(spark, d)).select("pid", "time", r6("value").alias("value"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS DOUBLE) AS half, 3.0 AS items, event_id + 0.5 AS second FROM events")
def parse_json_numbers(spark, d):
    ev = supplied.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    text = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(", "), (F.col("event_id") + 0.5).cast("string"), F.lit(", nothing]"))
    array = series.parse_array(text)
    half = F.when(F.col("event_id") % 2 == 0, F.col("k")).otherwise("none")
    return ev.select("event_id", stats.number(F.col("k")).alias("k"), stats.number(half).alias("half"), F.size(array).cast("double").alias("items"), F.element_at(array, 2).alias("second"))


@query("SELECT pid, CASE WHEN k % 4 = 0 THEN 1950.0 - time ELSE time END AS time FROM weekly JOIN records USING (pid)", "weekly", "records")
def before_present_years(spark, d):
    k = F.regexp_extract("pid", "([0-9]+)", 1).cast("int")
    unit = F.when(k % 4 == 0, F.when(k % 8 == 0, " Cal BP ").otherwise("yr bp")).otherwise("AD")
    return supplied.weekly(spark, d).select("pid", series.common_era(F.col("time"), unit).alias("time"))


@query("SELECT pid, lat, lon, archive, source, error FROM places", "places")
def record_table(spark, d):
    rec = supplied.records(spark, d)
    return rec.select("pid", "lat", "lon", "archive", F.element_at("metadata", F.lit("dataSetName")).alias("source"), stats.number(F.element_at("metadata", F.lit("measurement_error"))).alias("error"))


@query("SELECT pid, CAST(count(*) AS BIGINT) AS samples, round(min(time), 6) AS start, round(max(time), 6) AS stop, round(sum(value), 4) AS total FROM weekly GROUP BY pid", "weekly")
def nested_source_read(spark, d):
    """Series packed into array cells, some as text, and read back by the nested adapter."""
    rows = supplied.weekly(spark, d).groupBy("pid").agg(F.collect_list(F.struct("time", "value")).alias("s"))
    packed = rows.select(F.col("pid").alias("datasetId"), F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["time"].cast("string")), ", "), F.lit("]")).alias("year"), F.transform("s", lambda x: x["value"]).alias("paleoData_values"), F.lit("AD").alias("yearUnits"), F.lit("Wood").alias("archiveType"))
    read = series.load_series(packed)
    return read.observations.groupBy("pid").agg(F.count(F.lit(1)).alias("samples"), r6(F.min("time")).alias("start"), r6(F.max("time")).alias("stop"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT pid, lower(archive) AS archive, CAST(count(*) AS BIGINT) AS samples FROM weekly JOIN places USING (pid) GROUP BY ALL", "weekly", "places")
def compact_source_read(spark, d):
    """Samples with a dotted type, read by the compact adapter."""
    obs, rec = supplied.weekly(spark, d), supplied.records(spark, d)
    flat = obs.join(rec.select("pid", "lat", "lon", "elev", F.concat(F.lower("archive"), F.lit(".width")).alias("ptype")), "pid")
    read = series.load_series(flat)
    return read.observations.groupBy("pid").agg(F.count(F.lit(1)).alias("samples")).join(read.records.select("pid", "archive"), "pid").select("pid", "archive", "samples")


# predicates and roles


@query("SELECT pid, resolution FROM res", "res")
def native_resolution(spark, d):
    return temporal.native_resolution(supplied.weekly(spark, d))


@query("SELECT pid, min(time) AS start, max(time) AS \"end\", count(*) AS samples, any_value(resolution) AS resolution FROM weekly JOIN res USING (pid) GROUP BY pid", "res")
def record_metadata(spark, d):
    return temporal.record_metadata(supplied.weekly(spark, d))


@query("""SELECT pid, concat_ws('|', CASE WHEN NOT lat BETWEEN -80 AND -30 THEN 'latitude' END, CASE WHEN NOT (((lon + 180) % 360) - 180 >= 150 OR ((lon + 180) % 360) - 180 <= -100) THEN 'longitude' END,
CASE WHEN lower(archive) NOT IN ('wood', 'coral') THEN 'archive' END) AS reasons, lat BETWEEN -80 AND -30 AND (((lon + 180) % 360) - 180 >= 150 OR ((lon + 180) % 360) - 180 <= -100) AND lower(archive) IN ('wood', 'coral') AS included FROM places""", "places")
def filter_decisions(spark, d):
    rec = supplied.records(spark, d).join(temporal.record_metadata(supplied.weekly(spark, d)), "pid", "left")
    cfg = FilterConfig(latitude=(-80, -30), longitude=(150, 260), archives=("WOOD", "coral"), proxies=("Width",))
    return filters.filter_decisions(rec, cfg).select("pid", "reasons", "included")


@query("SELECT pid FROM places WHERE ((lon + 180) % 360) - 180 BETWEEN -60 AND 100", "places")
def wrap_longitude_filter(spark, d):
    return supplied.records(spark, d).where(filters.in_longitudes(F.col("lon"), 300, 100)).select("pid")


RESOLUTIONS = "SELECT pid, CAST(k % 13 AS DOUBLE) + 0.5 AS resolution FROM records"


@query(f"SELECT pid, CASE WHEN resolution <= 1.5 THEN 'annual' WHEN resolution <= 10 THEN 'window' ELSE 'excluded' END AS role, CASE WHEN resolution > 1.5 AND resolution <= 10 THEN CASE WHEN resolution <= 2 THEN 2 WHEN resolution <= 3 THEN 3 WHEN resolution <= 5 THEN 5 ELSE 10 END END AS band FROM ({RESOLUTIONS})", "records")
def resolution_roles(spark, d):
    rec = supplied.records(spark, d).withColumn("resolution", F.regexp_extract("pid", "([0-9]+)", 1).cast("int") % 13 + 0.5)
    return rec.select("pid", filters.reconstruction_role(F.col("resolution")).alias("role"), filters.resolution_band(F.col("resolution")).alias("band"))


@query(f"SELECT archive, pid, resolution <= 3.5 OR sum(CASE WHEN resolution <= 3.5 THEN 1 ELSE 0 END) OVER (PARTITION BY archive) < 3 AS is_core FROM ({RESOLUTIONS}) JOIN places USING (pid)", "places")
def core_roles(spark, d):
    rec = supplied.records(spark, d).withColumn("resolution", F.regexp_extract("pid", "([0-9]+)", 1).cast("int") % 13 + 0.5)
    return filters.core_roles(rec, 3.5, 3, ["archive"]).select("archive", "pid", "is_core")


@query("SELECT pid, round(avg(x), 6) AS x, count(*) AS n FROM pairs WHERE year BETWEEN 50 AND 200 AND pid IN (SELECT pid FROM places WHERE archive = 'Wood') GROUP BY pid", "pairs", "places")
def period_and_subset(spark, d):
    rows = filters.subset(pairs_of(spark, d), supplied.records(spark, d).where("archive = 'Wood'"))
    years = filters.calibration_years(supplied.weekly_target(spark, d), (50, 200))
    return rows.join(years.select("year"), "year", "left_semi").groupBy("pid").agg(r6(F.avg("x")).alias("x"), F.count(F.lit(1)).alias("n"))


# time


@query("SELECT pid, year, round(value, 6) AS value FROM annual", "annual")
def annualize_step_mean(spark, d):
    return temporal.annualize(supplied.weekly(spark, d)).select("pid", "year", r6("value").alias("value"))


SEASON = """WITH m AS (SELECT pid, CAST(floor(time) AS INTEGER) AS y, greatest(1, least(12, CAST(floor((time - floor(time)) * 12 + 1e-7) AS INTEGER) + 1)) AS month, value FROM calendar)
SELECT pid, y + CASE WHEN month > 2 THEN 1 ELSE 0 END AS year, round(avg(value), 6) AS value FROM m WHERE month IN (12, 1, 2) GROUP BY 1, 2 HAVING count(DISTINCT month) >= 3"""


@query(SEASON, "calendar")
def season_year_mean(spark, d):
    return temporal.annualize(supplied.calendar(spark, d), (12, 1, 2)).select("pid", "year", r6("value").alias("value"))


MONTHLY = """WITH o AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT CAST(y - CASE WHEN m < 11 THEN 1 ELSE 0 END AS INTEGER) AS year, round(avg(v), 6) AS y FROM o WHERE m IN (11, 12, 1, 2, 3) GROUP BY 1 HAVING count(DISTINCT m) >= 4"""


@query(MONTHLY)
def monthly_unpivot_target(spark, d):
    orders = supplied.table(spark, d, "orders").select(F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("m"), "o_totalprice")
    names = ["Jan", "Feb", "March", "Apr", "May", "June", "Jul", "Aug", "Sept", "Oct", "Nov", "December"]
    wide = orders.groupBy("Year").agg(*[F.avg(F.when(F.col("m") == k, F.col("o_totalprice"))).alias(n[:3] if n == "Sept" else n) for k, n in enumerate(names, 1)])
    return series.load_observations(wide, months=(11, 12, 1, 2, 3), anchor="start").select("year", r6("y").alias("y"))


@query("SELECT CAST(s AS INTEGER) AS window_id, CAST(s AS INTEGER) AS window_start, CAST(least(s + 4, 33) AS INTEGER) AS window_end, (s + least(s + 4, 33)) / 2.0 AS window_center, CAST(least(s + 4, 33) - s + 1 AS INTEGER) AS window_year_count FROM range(0, 34, 5) t(s)")
def tumbling_windows(spark, d):
    return temporal.window_table(spark, 0, 33, 5)


@query("SELECT pid, CAST(floor((time + 0.5) / 5) * 5 AS INTEGER) AS window_id, round(avg(value), 6) AS value FROM weekly GROUP BY 1, 2", "weekly")
def native_window_means(spark, d):
    return temporal.native_window_means(supplied.weekly(spark, d), 0, WEEKS, 5).select("pid", "window_id", r6("value").alias("value"))


COMPLETE = """WITH w AS (SELECT CAST(floor(year / 5.0) * 5 AS INTEGER) AS id, avg(y) AS y, count(*) AS n FROM target WHERE year BETWEEN 0 AND 359 GROUP BY 1),
p AS (SELECT pid, CAST(floor((year + 0.5) / 5) * 5 AS INTEGER) AS id, avg(value) AS x FROM gappy GROUP BY 1, 2)
SELECT pid, p.id AS window_id, round(x, 6) AS x, round(w.y, 6) AS y FROM p JOIN w ON p.id = w.id WHERE n = 5"""


@query(COMPLETE, "gappy", "target")
def complete_window_pairs(spark, d):
    got = temporal.complete_window_pairs(supplied.supplier_weeks(spark, d), supplied.weekly_target(spark, d), 0, WEEKS, 5)
    return got.select("pid", "window_id", r6("x").alias("x"), r6("y").alias("y"))


@query("SELECT p.pid, CAST(g.year AS INTEGER) AS year, round(value, 6) AS value FROM (SELECT DISTINCT pid FROM annual) p CROSS JOIN range(0, 360) g(year) LEFT JOIN annual a ON a.pid = p.pid AND a.year = g.year", "annual")
def dense_matrix_long(spark, d):
    return temporal.dense_matrix(annual_of(spark, d), 0, WEEKS).select("pid", "year", r6("value").alias("value"))


FILL = """WITH g AS (SELECT p.pid, CAST(r.year AS INTEGER) AS year, value FROM (SELECT DISTINCT pid FROM gappy) p CROSS JOIN range(0, 360) r(year) LEFT JOIN gappy a ON a.pid = p.pid AND a.year = r.year),
b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN year END IGNORE NULLS) OVER w0 AS y0, last_value(value IGNORE NULLS) OVER w0 AS v0, first_value(CASE WHEN value IS NOT NULL THEN year END IGNORE NULLS) OVER w1 AS y1, first_value(value IGNORE NULLS) OVER w1 AS v1 FROM g
WINDOW w0 AS (PARTITION BY pid ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w1 AS (PARTITION BY pid ORDER BY year ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
f AS (SELECT pid, year, value IS NOT NULL AS is_native, coalesce(value IS NULL AND y1 - y0 - 1 <= 2, false) AS is_interpolated, value, v0 + (v1 - v0) * (year - y0) / (y1 - y0) AS line FROM b)
"""


@query(FILL + "SELECT pid, year, round(CASE WHEN is_interpolated THEN line ELSE value END, 6) AS value, is_native, is_interpolated FROM f", "gappy")
def bounded_gap_fill(spark, d):
    dense = temporal.dense_matrix(gappy_of(spark, d), 0, WEEKS)
    return temporal.fill_short_gaps(dense, 2).select("pid", "year", r6("value").alias("value"), "is_native", "is_interpolated")


@query(FILL + "SELECT pid, CAST(sum(CAST(is_native AS INTEGER)) AS BIGINT) AS native_years, CAST(sum(CAST(is_interpolated AS INTEGER)) AS BIGINT) AS interpolated_years FROM f GROUP BY pid", "gappy")
def gap_fill_audit(spark, d):
    return temporal.gap_audit(temporal.fill_short_gaps(temporal.dense_matrix(gappy_of(spark, d), 0, WEEKS), 2))


@query(FILL + """SELECT year, CAST(count(*) FILTER (is_native OR is_interpolated) AS BIGINT) AS available, CAST(count(*) FILTER (is_native) AS BIGINT) AS native, CAST(count(*) FILTER (is_interpolated) AS BIGINT) AS interpolated,
CAST(count(*) FILTER (is_native OR is_interpolated) AS DOUBLE) AS effective, CASE WHEN count(*) FILTER (is_native) > 0 THEN 'native' WHEN count(*) FILTER (is_interpolated) > 0 THEN 'interpolated_only' ELSE 'unconstrained' END AS label FROM f GROUP BY year""", "gappy")
def availability_labels(spark, d):
    return temporal.availability(temporal.fill_short_gaps(temporal.dense_matrix(gappy_of(spark, d), 0, WEEKS), 2))


AVAILABILITY = f"""WITH a AS (SELECT 's' || l_suppkey AS pid, CAST({WEEK.replace("day)", "CAST(l_shipdate AS DATE))")} AS INTEGER) AS year, avg(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2),
g AS (SELECT p.pid, CAST(r.year AS INTEGER) AS year, value FROM (SELECT DISTINCT pid FROM a) p CROSS JOIN range(0, 360) r(year) LEFT JOIN a ON a.pid = p.pid AND a.year = r.year),
b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN year END IGNORE NULLS) OVER w0 AS y0, first_value(CASE WHEN value IS NOT NULL THEN year END IGNORE NULLS) OVER w1 AS y1 FROM g
WINDOW w0 AS (PARTITION BY pid ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w1 AS (PARTITION BY pid ORDER BY year ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
f AS (SELECT pid, year, value IS NOT NULL AS is_native, coalesce(value IS NULL AND y1 - y0 - 1 <= 2, false) AS is_filled FROM b),
m AS (SELECT 's' || s_suppkey AS pid, 1.0 / (1 + s_nationkey % 4) AS weight FROM supplier WHERE s_acctbal >= 0),
o AS (SELECT DISTINCT 'c' || o_custkey AS pid, CAST({WEEK.replace("day)", "CAST(o_orderdate AS DATE))")} AS DOUBLE) AS time FROM orders),
n AS (SELECT pid, time, time - lag(time) OVER w AS g0, lead(time) OVER w - time AS g1 FROM o WINDOW w AS (PARTITION BY pid ORDER BY time)), s AS (SELECT pid, median(g0) AS res FROM n GROUP BY pid),
v AS (SELECT pid, time, least(greatest(CASE WHEN g0 IS NULL AND g1 IS NULL THEN 1 ELSE (coalesce(g0, g1) + coalesce(g1, g0)) / 2 END, 1), coalesce(greatest(1, 3 * res), 1e9)) AS width FROM n JOIN s USING (pid)),
l AS (SELECT y.year, count(DISTINCT pid) AS low FROM range(0, 360) y(year) LEFT JOIN v ON y.year >= time - width / 2 AND y.year < time + width / 2 GROUP BY 1),
c AS (SELECT year, count(*) FILTER (is_native OR is_filled) AS available, count(*) FILTER ((is_native OR is_filled) AND weight IS NOT NULL) AS model, count(*) FILTER (is_native AND weight IS NOT NULL) AS native, count(*) FILTER (is_filled AND weight IS NOT NULL) AS filled, coalesce(sum(weight) FILTER (is_native OR is_filled), 0) AS effective FROM f LEFT JOIN m USING (pid) GROUP BY year)
SELECT 'main' AS run, c.year, available AS available_proxy_count, model AS model_proxy_count, native AS native_model_proxy_count, filled AS interpolated_model_proxy_count, filled > 0 AS uses_interpolated_proxy, round(effective, 6) AS effective_model_proxy_count, low AS low_resolution_support_count, CASE WHEN model >= 15 THEN 'annual_core' WHEN low > 0 THEN 'low_frequency_only' ELSE 'unconstrained' END AS state_support FROM c JOIN l USING (year)"""


@query(AVAILABILITY)
def availability_audit(spark, d):
    """Suppliers' weeks as the annual core, gaps as they are; a model of some of them with weights; customers' orders as slow series."""
    week = lambda c: F.floor(F.datediff(F.to_date(c), F.lit(supplied.ORIGIN).cast("date")) / 7.0)
    core = supplied.table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("pid"), week("l_shipdate").cast("int").alias("year")).agg(F.avg("l_quantity").alias("value"))
    filled = temporal.fill_short_gaps(temporal.dense_matrix(core, 0, WEEKS), 2)
    model = supplied.table(spark, d, "supplier").where("s_acctbal >= 0").select(F.lit("main").alias("run"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("pid"), (1.0 / (1 + F.col("s_nationkey") % 4)).alias("weight"))
    orders = supplied.table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("pid"), week("o_orderdate").cast("double").alias("time")).agg(F.avg("o_totalprice").alias("value"))
    named = lambda df: df.select(F.lit("main").alias("run"), "pid").distinct()
    got = temporal.labelled_availability(filled, named(core), model, named(orders), orders, 15)
    return got.withColumn("effective_model_proxy_count", r6("effective_model_proxy_count"))


@query("""WITH f AS (SELECT pid, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM annual JOIN target USING (year) WHERE year BETWEEN 50 AND 150 AND y >= 25.5 GROUP BY pid)
SELECT a.pid, a.year, round(CASE WHEN n >= 2 AND s > 0 THEN (value - m) / s END, 6) AS value, round(m, 6) AS reference_mean, round(s, 6) AS reference_sd, n AS reference_n FROM annual a LEFT JOIN f USING (pid)""", "annual", "target")
def period_zscore(spark, d):
    allowed = supplied.weekly_target(spark, d).where("y >= 25.5").select("year")
    z = temporal.reference_zscore(annual_of(spark, d), 50, 150, allowed)
    return z.select("pid", "year", r6("value").alias("value"), r6("reference_mean").alias("reference_mean"), r6("reference_sd").alias("reference_sd"), "reference_n")


@query("""WITH f AS (SELECT pid, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM weekly WHERE time BETWEEN 50 AND 150 GROUP BY pid)
SELECT w.pid, w.time, round(CASE WHEN n >= 2 AND s > 0 THEN (value - m) / s END, 6) AS value FROM weekly w LEFT JOIN f USING (pid)""", "weekly")
def native_zscore(spark, d):
    return temporal.native_zscore(supplied.weekly(spark, d), 50, 150).select("pid", "time", r6("value").alias("value"))


@query("""WITH f AS (SELECT pid, regr_slope(value, year) AS b, regr_intercept(value, year) AS a FROM annual GROUP BY pid)
SELECT pid, year, round(value - a - b * year, 6) AS value FROM annual JOIN f USING (pid)""", "annual")
def linear_detrend(spark, d):
    return temporal.linear_detrend(annual_of(spark, d)).select("pid", "year", r6("value").alias("value"))


WIDTHS = """WITH g AS (SELECT pid, time, time - lag(time) OVER w AS g0, lead(time) OVER w - time AS g1 FROM by_user WINDOW w AS (PARTITION BY pid ORDER BY time)),
s AS (SELECT pid, median(g0) AS res FROM g GROUP BY pid),
v AS (SELECT pid, time, least(greatest(CASE WHEN g0 IS NULL AND g1 IS NULL THEN 1 ELSE (coalesce(g0, g1) + coalesce(g1, g0)) / 2 END, 1), coalesce(greatest(1, 3 * res), 1e9)) AS width FROM g JOIN s USING (pid))
"""


@query(WIDTHS + "SELECT pid, time, round(width, 6) AS width FROM v", "by_user")
def native_support_widths(spark, d):
    obs = supplied.user_steps(spark, d)
    return temporal.support_widths(obs).select("pid", "time", r6("width").alias("width"))


@query(WIDTHS + "SELECT CAST(y.year AS INTEGER) AS year, CAST(count(DISTINCT pid) AS BIGINT) AS support FROM range(0, 721) y(year) LEFT JOIN v ON y.year >= time - width / 2 AND y.year < time + width / 2 GROUP BY 1", "by_user")
def native_support_cover(spark, d):
    obs = supplied.user_steps(spark, d)
    return temporal.support_counts(obs, 0, 720)


@query("""WITH e AS (SELECT DISTINCT pid, CAST(time AS INTEGER) AS year FROM events_by), i AS (SELECT pid, year, year - row_number() OVER (PARTITION BY pid ORDER BY year) AS island FROM e),
r AS (SELECT pid, min(year) AS start, max(year) AS "end", count(*) AS years FROM i GROUP BY pid, island)
SELECT pid, start, "end", years FROM r QUALIFY row_number() OVER (PARTITION BY pid ORDER BY years DESC, start) = 1""", "events_by")
def longest_contiguous_run(spark, d):
    rows = supplied.event_steps(spark, d).select("pid", F.col("time").cast("int").alias("year"), "value")
    return temporal.longest_run(rows, ["pid"])


# deduplication


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Brands, exact copies of every third, and copies of every fourth rounded to four places."""
    obs, rec = supplied.weekly(spark, d), supplied.records(spark, d)
    k = F.regexp_extract("pid", "([0-9]+)", 1).cast("int")
    tags = [(F.lit(True), "", "value"), (k % 3 == 0, "-copy", "value"), (k % 4 == 0, "-round", "rounded")]
    obs = obs.withColumn("rounded", F.round("value", 4) + F.lit(2e-5))
    all_obs = all_rec = None
    for n, (which, tag, column) in enumerate(tags):
        o = obs.where(which).select(F.concat("pid", F.lit(tag)).alias("pid"), "time", F.col(column).alias("value"))
        r = rec.where(which).select(F.concat("pid", F.lit(tag)).alias("pid"), (k + 100 * n).cast("long").alias("seq"), F.lit(5 if tag == "-copy" else 4).alias("quality"), F.lit(tag != "").alias("has_url"), "archive", "proxy", F.lit("v").alias("variable"), "lat", "lon")
        all_obs, all_rec = (o, r) if all_obs is None else (all_obs.unionByName(o), all_rec.unionByName(r))
    return all_rec, all_obs


@query("SELECT pid || CASE WHEN k % 3 = 0 THEN '-copy' ELSE '' END AS keep_pid, pid, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS group_size FROM records UNION ALL SELECT pid || '-copy', pid || '-copy', 2 FROM records WHERE k % 3 = 0", "records")
def exact_dedup(spark, d):
    rec, obs = _copies(spark, d)
    return dedup.exact_groups(rec.where("pid not like '%-round'"), obs.where("pid not like '%-round'")).select("keep_pid", "pid", "group_size")


@query("""WITH g AS (SELECT pid, k FROM records)
SELECT CASE WHEN k % 3 = 0 THEN pid || '-copy' ELSE pid END AS kept FROM g WHERE k % 4 <> 0 UNION ALL SELECT CASE WHEN k % 3 = 0 THEN pid || '-copy' ELSE pid || '-round' END FROM g WHERE k % 4 = 0""", "records")
def near_dedup(spark, d):
    rec, obs = _copies(spark, d)
    kept, _, _ = dedup.deduplicate(rec, obs)
    return kept.select(F.col("pid").alias("kept"))


@query("SELECT CAST(count(*) FILTER (k % 3 = 0) AS BIGINT) AS exact, CAST(count(*) FILTER (k % 4 = 0) AS BIGINT) AS near, CAST(count(*) FILTER (k % 3 = 0) + count(*) FILTER (k % 4 = 0) AS BIGINT) AS dropped FROM records", "records")
def dedup_audit(spark, d):
    rec, obs = _copies(spark, d)
    _, dropped, groups = dedup.deduplicate(rec, obs)
    n = dropped.agg(F.count(F.lit(1)).alias("dropped"))
    return groups.agg(F.sum(F.col("group_id").startswith("exact").cast("long")).alias("exact"), F.sum(F.col("group_id").startswith("near").cast("long")).alias("near")).crossJoin(n)


# screening

LAG = """WITH l AS (SELECT *, lead(year) OVER w AS y2, lead(x) OVER w AS x2, lead(y) OVER w AS t2 FROM pairs WINDOW w AS (PARTITION BY pid ORDER BY year)),
a AS (SELECT pid, count(*) AS n, corr(x, y) AS r, greatest(-0.99, least(0.99, corr(x, x2) FILTER (y2 - year = 1))) AS ra, greatest(-0.99, least(0.99, corr(y, t2) FILTER (y2 - year = 1))) AS rb, count(*) FILTER (y2 - year = 1) AS adjacent FROM l GROUP BY pid),
e AS (SELECT pid, n, r, ra, rb, adjacent, greatest(3.0, least(n, n * (1 - ra * rb) / (1 + ra * rb))) AS n_eff FROM a)
"""


@query(LAG + "SELECT pid, round(ra, 6) AS lag_x, round(rb, 6) AS lag_y, adjacent FROM e", "pairs")
def lag1_autocorr(spark, d):
    rows = pairs_of(spark, d).withColumn("step", F.lit(1))
    return screening.lag_one(rows, ["pid"], "step").select("pid", r6("lag_x").alias("lag_x"), r6("lag_y").alias("lag_y"), "adjacent")


@query(LAG + "SELECT pid, n, round(r, 6) AS r, round(n_eff, 6) AS n_eff, round(r * sqrt(greatest(n_eff - 2, 0) / greatest(1 - r * r, 2.220446049250313e-16)), 6) AS t, adjacent FROM e", "pairs")
def effective_dof_screen(spark, d):
    """The flagship: which series track the target."""
    got = screening.effective_correlation(pairs_of(spark, d), with_p=False)
    return got.select("pid", "n", r6("r").alias("r"), r6("n_eff").alias("n_eff"), r6("t").alias("t"), "adjacent")


TAIL = """, q AS (SELECT pid, n, r, greatest(n_eff - 2, 1) AS nu, r * r * greatest(n_eff - 2, 0) / greatest(1 - r * r, 2.220446049250313e-16) AS tt FROM e),
g AS (SELECT *, asin(sqrt(nu / (nu + tt))) AS top FROM q),
p AS (SELECT pid, any_value(n) AS n, any_value(r) AS r, any_value(2 * exp(lgamma(nu / 2 + 0.5) - lgamma(nu / 2) - lgamma(0.5)) * top / 6000) * sum(CASE WHEN k % 2000 = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(sin(top * k / 2000), nu - 1)) AS p FROM g, range(0, 2001) s(k) GROUP BY pid)
"""


@query(LAG + TAIL + "SELECT pid, n, round(r, 6) AS r, round(p, 6) AS p FROM p", "pairs")
def effective_dof_p(spark, d):
    """The same with p values; the SQL integrates Student's tail by Simpson's rule over an angle."""
    return screening.effective_correlation(pairs_of(spark, d)).select("pid", "n", r6("r").alias("r"), r6("p").alias("p"))


P_VALUES = "SELECT pid, archive, CASE WHEN k % 11 = 0 THEN NULL ELSE ((k * 37) % 101) / 1000.0 END AS p, k FROM places"


def _p_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("pid", "([0-9]+)", 1).cast("int")
    return supplied.records(spark, d).select("pid", "archive", F.when(k % 11 != 0, ((k * 37) % 101) / 1000.0).alias("p"), k.alias("k"))


@query(f"""WITH p AS ({P_VALUES}), k AS (SELECT *, count(p) OVER (PARTITION BY archive) AS m, row_number() OVER (PARTITION BY archive ORDER BY p NULLS LAST, pid) AS i FROM p)
SELECT archive, pid, round(CASE WHEN p IS NOT NULL THEN least(1, max(CASE WHEN p IS NOT NULL THEN (m - i + 1) * p END) OVER (PARTITION BY archive ORDER BY i ROWS UNBOUNDED PRECEDING)) END, 6) AS holm FROM k""", "places")
def holm_adjust(spark, d):
    return stats.holm(_p_values(spark, d), "p", "holm", ["archive"], ["pid"]).select("archive", "pid", r6("holm").alias("holm"))


@query(f"""WITH p AS ({P_VALUES}), k AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p NULLS LAST, pid) AS i FROM p)
SELECT pid, round(CASE WHEN p IS NOT NULL THEN least(1, min(CASE WHEN p IS NOT NULL THEN p * m / i END) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) END, 6) AS bh FROM k""", "places")
def bh_adjust(spark, d):
    return stats.benjamini_hochberg(_p_values(spark, d), "p", "bh", (), ["pid"]).select("pid", r6("bh").alias("bh"))


@query(f"""WITH p AS ({P_VALUES}), s AS (SELECT *, coalesce(p <= 0.07, false) AS sel FROM p), k AS (SELECT *, CASE WHEN sel AND archive IN ('Wood', 'Coral') THEN row_number() OVER (PARTITION BY archive, sel ORDER BY p NULLS LAST, abs((k % 7) / 10.0) DESC, k DESC, pid) END AS place FROM s)
SELECT pid, sel AND NOT coalesce(place > CASE archive WHEN 'Wood' THEN 2 ELSE 1 END, false) AS selected, CAST(place AS INTEGER) AS archive_rank, coalesce(place > CASE archive WHEN 'Wood' THEN 2 ELSE 1 END, false) AS excluded_by_cap FROM k""", "places")
def archive_topk(spark, d):
    rows = _p_values(spark, d).select("pid", "archive", F.col("p").alias("p_proxy"), (F.col("k") % 7 / 10.0).alias("r"), F.col("k").cast("double").alias("n_eff"), F.coalesce(F.col("p") <= 0.07, F.lit(False)).alias("selected"))
    return screening.archive_top(rows, (("wood", 2), ("CORAL", 1))).select("pid", "selected", "archive_rank", "excluded_by_cap")


SEASONS_SQL = """WITH m AS (SELECT pid, CAST(floor(time) AS INTEGER) AS y, greatest(1, least(12, CAST(floor((time - floor(time)) * 12 + 1e-7) AS INTEGER) + 1)) AS month, value FROM calendar),
s AS (SELECT 0 AS season, unnest(range(1, 13)) AS month UNION ALL SELECT 1, unnest([12, 1, 2]) UNION ALL SELECT 2, unnest([3, 4, 5]) UNION ALL SELECT 3, unnest([6, 7, 8])),
n AS (SELECT season, count(*) AS months, ceil(count(*) * 0.75) AS need FROM s GROUP BY season),
v AS (SELECT pid, season, y + CASE WHEN season = 1 AND month > 2 THEN 1 WHEN season = 2 AND month > 5 THEN 1 WHEN season = 3 AND month > 8 THEN 1 ELSE 0 END AS year, avg(value) AS x, count(DISTINCT month) AS c FROM m JOIN s USING (month) GROUP BY ALL),
t AS (SELECT year(o_orderdate) AS year, avg(o_totalprice) AS y FROM orders GROUP BY 1),
r AS (SELECT pid, season, count(*) AS n, corr(x, y) AS r FROM v JOIN n USING (season) JOIN t USING (year) WHERE c >= need GROUP BY ALL)
SELECT pid, season, n, round(r, 6) AS r FROM r QUALIFY row_number() OVER (PARTITION BY pid ORDER BY n >= 4 DESC, abs(r) DESC NULLS LAST, season) = 1"""


@query(SEASONS_SQL, "calendar")
def best_season(spark, d):
    names = ("1,2,3,4,5,6,7,8,9,10,11,12", "12,1,2", "3,4,5", "6,7,8")
    cfg = ScreeningConfig(season_candidates=tuple(tuple(map(int, n.split(","))) for n in names), min_overlap=4, low_resolution_min_overlap=4)
    target = supplied.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("y"))
    obs = supplied.calendar(spark, d)
    tests = screening.effective_correlation(screening.candidate_pairs(obs, target, cfg), ["pid", "season"], with_p=False)
    tests = tests.withColumn("p", F.lit(0.5)).join(temporal.native_resolution(obs), "pid")
    place = F.element_at(F.create_map(*[F.lit(x) for kv in ((n, k) for k, n in enumerate(names)) for x in kv]), F.col("season"))
    return screening.best_season(tests, cfg, names).select("pid", place.alias("season"), "n", r6("r").alias("r"))


#: Pairs by year, and by whole windows for series that are coarser than the cutoff.
PAIRED = """WITH bd AS (SELECT min(year) AS lo, max(year) AS hi FROM target),
wd AS (SELECT pid, resolution, CAST(CASE WHEN resolution > 1.5 THEN CASE WHEN resolution <= 2 THEN 2 WHEN resolution <= 3 THEN 3 WHEN resolution <= 5 THEN 5 WHEN resolution <= 10 THEN 10 ELSE ceil(resolution) END ELSE 1 END AS INTEGER) AS step FROM res),
tw AS (SELECT step, id, avg(y) AS y FROM (SELECT step, hi, y, CAST(lo + floor((year - lo) / step) * step AS INTEGER) AS id FROM target, bd, (SELECT DISTINCT step FROM wd WHERE step > 1)) GROUP BY step, id HAVING count(*) = step AND id + step - 1 <= max(hi)),
xw AS (SELECT pid, step, CAST(lo + floor((time + 0.5 - lo) / step) * step AS INTEGER) AS id, avg(value) AS x FROM weekly JOIN wd USING (pid), bd WHERE step > 1 AND time >= lo AND time < hi + 0.5 GROUP BY ALL),
pp AS (SELECT p.pid, step, year, x, y FROM pairs p JOIN wd USING (pid) WHERE step = 1 UNION ALL SELECT pid, xw.step, xw.id, x, y FROM xw JOIN tw ON xw.step = tw.step AND xw.id = tw.id),
l AS (SELECT *, lead(year) OVER w AS y2, lead(x) OVER w AS x2, lead(y) OVER w AS t2 FROM pp WINDOW w AS (PARTITION BY pid ORDER BY year)),
c AS (SELECT pid, any_value(step) AS step, count(*) AS n, corr(x, y) AS r, corr(x, x2) FILTER (y2 - year = step) AS ra, corr(y, t2) FILTER (y2 - year = step) AS rb, count(*) FILTER (y2 - year = step) AS adjacent FROM l GROUP BY pid),
a AS (SELECT pid, step, n, r, adjacent, CASE WHEN adjacent >= 2 THEN coalesce(greatest(-0.99, least(0.99, ra)) * greatest(-0.99, least(0.99, rb)), 0) ELSE 0 END AS ab FROM c),
e AS (SELECT *, greatest(3.0, least(n, n * (1 - ab) / (1 + ab))) AS n_eff FROM a)
"""
SCREENED = """, s AS (SELECT p.pid, archive, p.n, p.r, n_eff, p.r * sqrt(greatest(n_eff - 2, 0) / greatest(1 - p.r * p.r, 2.220446049250313e-16)) AS t, adjacent, p, e.step, resolution, CASE WHEN resolution >= 1.5 THEN 8 ELSE 20 END AS required FROM p JOIN e USING (pid) JOIN places USING (pid) JOIN res USING (pid)),
k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, pid) AS i FROM s),
b AS (SELECT *, least(1, min(p * m / i) OVER (ORDER BY i DESC)) AS p_proxy, n >= required AND abs(r) >= 0.05 AND p <= 1 AS passes FROM k),
o AS (SELECT *, CASE WHEN passes AND archive = 'Wood' THEN row_number() OVER (PARTITION BY archive, passes ORDER BY p_proxy, abs(r) DESC, n_eff DESC, pid) END AS archive_rank FROM b)
SELECT pid, archive, '1,2,3,4,5,6,7,8,9,10,11,12' AS season, CASE WHEN step > 1 THEN 'native_window' ELSE 'annual' END AS pairing, step, n, round(r, 6) AS r, round(n_eff, 6) AS n_eff, round(t, 6) AS t, adjacent, round(p, 6) AS p, resolution, CAST(required AS INTEGER) AS required, round(p, 6) AS p_adjusted, CAST(1 AS BIGINT) AS seasons_tested, passes, round(p_proxy, 6) AS p_proxy,
passes AND coalesce(archive_rank <= 3, true) AS selected, CAST(archive_rank AS INTEGER) AS archive_rank, coalesce(archive_rank > 3, false) AS excluded_by_cap, passes AS selected_before_cap FROM o"""


@query(PAIRED + TAIL + SCREENED, "weekly", "pairs", "places", "res")
def screening_table(spark, d):
    """The whole screening of brands by week against all sales."""
    cfg = ScreeningConfig(p_threshold=1.0, r_threshold=0.05, archive_max_counts=(("Wood", 3),))
    got = screening.screen(supplied.weekly(spark, d), supplied.records(spark, d), supplied.weekly_target(spark, d), cfg)
    return got.withColumns({c: r6(c) for c in ("r", "n_eff", "t", "p", "p_adjusted", "p_proxy")}).drop("proxy", "lat", "lon")


# pairs and weights


@query("SELECT a.pid AS a, b.pid AS b, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM annual a JOIN annual b ON a.year = b.year AND a.pid < b.pid GROUP BY 1, 2", "annual")
def pair_overlap_corr(spark, d):
    return weights.pair_correlations(annual_of(spark, d), 10).select("a", "b", "n", r6("r").alias("r"))


HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1, greatest(0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(((b.lon - a.lon + 180) % 360 + 360) % 360 - 180) / 2), 2)))))"


@query(f"SELECT a.pid AS a, b.pid AS b, round({HAVERSINE}, 5) AS km FROM places a JOIN places b ON a.archive = b.archive AND a.pid < b.pid", "places")
def haversine_pairs(spark, d):
    rec = supplied.records(spark, d)
    a, b = rec.select(F.col("pid").alias("a"), "archive", F.col("lat").alias("la"), F.col("lon").alias("oa")), rec.select(F.col("pid").alias("b"), "archive", F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    return a.join(b, "archive").where("a < b").select("a", "b", F.round(stats.haversine_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")), 5).alias("km"))


@query(f"""WITH e AS (SELECT a.pid AS a, b.pid AS b FROM places a JOIN places b ON a.archive = b.archive AND a.pid < b.pid WHERE a.source = b.source OR {HAVERSINE} <= 2500)
SELECT e.a, e.b, count(*) AS n, round(corr(x.value, y.value), 6) AS r FROM e JOIN annual x ON x.pid = e.a JOIN annual y ON y.pid = e.b AND y.year = x.year GROUP BY 1, 2 HAVING count(*) >= 20 AND abs(corr(x.value, y.value)) >= 0.02""", "annual", "places")
def redundancy_edges(spark, d):
    cfg = WeightConfig(enabled=True, radius_km=2500, correlation=0.02)
    return weights.redundancy_edges(supplied.records(spark, d), annual_of(spark, d), cfg).select("a", "b", "n", r6("r").alias("r"))


@query("""WITH s AS (SELECT pid, stddev_samp(value) AS sd FROM annual GROUP BY pid)
SELECT pid, round(sd, 6) AS calibration_sd, error AS error_sd, round(CASE WHEN error > 0 THEN coalesce(sd * sd / (sd * sd + error * error), 1) ELSE 1 END, 6) AS error_weight FROM places LEFT JOIN s USING (pid)""", "annual", "places")
def reliability_weights(spark, d):
    rec = weights.error_sd(supplied.records(spark, d), WeightConfig())
    return weights.reliability(rec, annual_of(spark, d)).select("pid", r6("calibration_sd").alias("calibration_sd"), "error_sd", r6("error_weight").alias("error_weight"))


@query(f"""WITH RECURSIVE e0 AS (SELECT a.pid AS a, b.pid AS b FROM places a JOIN places b ON a.archive = b.archive AND a.pid < b.pid WHERE a.source = b.source OR {HAVERSINE} <= 2500),
e AS (SELECT e0.a, e0.b FROM e0 JOIN annual x ON x.pid = e0.a JOIN annual y ON y.pid = e0.b AND y.year = x.year GROUP BY 1, 2 HAVING count(*) >= 20 AND abs(corr(x.value, y.value)) >= 0.02),
sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT pid AS node, pid AS spot FROM places UNION SELECT reach.node, sides.b FROM reach JOIN sides ON reach.spot = sides.a),
c AS (SELECT node AS pid, min(spot) AS label FROM reach GROUP BY 1)
SELECT pid, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS redundancy_group, CAST(count(*) OVER (PARTITION BY label) AS BIGINT) AS redundancy_group_size FROM c""", "annual", "places")
def redundancy_components(spark, d):
    cfg = WeightConfig(enabled=True, radius_km=2500, correlation=0.02)
    return weights.series_weights(supplied.records(spark, d), annual_of(spark, d), cfg).select("pid", "redundancy_group", "redundancy_group_size")


# nests

BOUNDS = "SELECT pid, CAST(k * 3 % 40 AS INTEGER) AS start, CAST(300 + (k * 7) % 45 AS INTEGER) AS \"end\" FROM records"


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("pid", "([0-9]+)", 1).cast("int")
    return supplied.records(spark, d).select("pid", (k * 3 % 40).alias("start"), (300 + (k * 7) % 45).alias("end"))


NESTS_SQL = f"""WITH b AS ({BOUNDS}), s AS (SELECT DISTINCT start AS s FROM b WHERE start >= 12 UNION SELECT max(start) FROM b WHERE start < 12), g AS (SELECT s, e FROM s CROSS JOIN (SELECT DISTINCT "end" AS e FROM b) WHERE e - s >= 280),
n AS (SELECT s, e, list_sort(list(pid)) AS pids FROM g JOIN b ON b.start <= g.s AND b."end" >= g.e GROUP BY s, e HAVING count(*) >= 2),
l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY pids ORDER BY e - s DESC, s, e) = 1)
"""


@query(NESTS_SQL + "SELECT 'nest_' || lpad(CAST(row_number() OVER (ORDER BY s, e, pids) AS VARCHAR), 3, '0') AS nest_id, s AS start, e AS \"end\", array_to_string(pids, '|') AS pids FROM l", "records")
def coverage_nests(spark, d):
    got = nests.coverage_nests(_bounds(spark, d), NestConfig(span=280, minimum_start=12))
    return got.withColumn("pids", F.array_join("pids", "|"))


@query(NESTS_SQL + """, i AS (SELECT 'nest_' || lpad(CAST(row_number() OVER (ORDER BY s, e, pids) AS VARCHAR), 3, '0') AS nest_id, s, e, unnest(pids) AS pid FROM l)
SELECT nest_id, count(*) AS cells, round(avg(value), 6) AS value FROM i JOIN annual a ON a.pid = i.pid AND a.year BETWEEN s AND e GROUP BY nest_id""", "records", "annual")
def nest_slices(spark, d):
    table = nests.coverage_nests(_bounds(spark, d), NestConfig(span=280, minimum_start=12))
    return nests.nest_slices(table, annual_of(spark, d)).groupBy("nest_id").agg(F.count(F.lit(1)).alias("cells"), r6(F.avg("value")).alias("value"))


# regressions of single series, holdout, combination


@query("SELECT pid, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n FROM pairs GROUP BY pid", "pairs")
def simple_ols_scores(spark, d):
    return pairs_of(spark, d).groupBy("pid").agg(r6(F.regr_slope("y", "x")).alias("slope"), r6(F.regr_intercept("y", "x")).alias("intercept"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT pid, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, stddev_samp(y) AS sy, covar_samp(x, y) AS c FROM pairs GROUP BY pid), s AS (SELECT *, sy / sx AS v, c / (sx * sx) AS o FROM a)
SELECT pid, round(least(4, greatest(0.25, v)), 6) AS variance_slope, round(my - least(4, greatest(0.25, v)) * mx, 6) AS variance_intercept, round(least(4, greatest(0.25, o)), 6) AS ols_slope, round(my - least(4, greatest(0.25, o)) * mx, 6) AS ols_intercept FROM s""", "pairs")
def amplitude_maps(spark, d):
    rows = pairs_of(spark, d).select("pid", "year", F.col("x").alias("predicted"), F.col("y").alias("observed"))
    v = amplitude.affine_maps(rows, ["pid"], "variance").select("pid", r6("slope").alias("variance_slope"), r6("intercept").alias("variance_intercept"))
    o = amplitude.affine_maps(rows, ["pid"], "ols").select("pid", r6("slope").alias("ols_slope"), r6("intercept").alias("ols_intercept"))
    return v.join(o, "pid")


@query("""WITH a AS (SELECT pid, year, x, (year * 7) % 5 + 1 AS availability FROM pairs), c AS (SELECT pid, availability, count(*) OVER (PARTITION BY pid ORDER BY availability DESC RANGE UNBOUNDED PRECEDING) AS n FROM a),
t AS (SELECT pid, max(availability) AS tier FROM c WHERE n >= 20 GROUP BY pid)
SELECT pid, CAST(tier AS INTEGER) AS tier, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd FROM a JOIN t USING (pid) WHERE availability >= tier GROUP BY ALL""", "pairs")
def densest_tier(spark, d):
    rows = pairs_of(spark, d).select("pid", F.col("x").alias("predicted"), (F.col("year") * 7 % 5 + 1).alias("availability"))
    return amplitude.densest_tier(rows, ["pid"], 20).select("pid", "tier", "n", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("SELECT pid, CAST(count(*) FILTER (held) AS BIGINT) AS held, CAST(count(*) FILTER (NOT held) AS BIGINT) AS train, CAST(sum(year) FILTER (held) AS BIGINT) AS years FROM held GROUP BY pid", "held")
def hash_holdout_split(spark, d):
    rows = validation.hash_holdout(pairs_of(spark, d), ["pid"], 1 / 3)
    return rows.groupBy("pid").agg(F.sum(F.col("held").cast("long")).alias("held"), F.sum((~F.col("held")).cast("long")).alias("train"), F.sum(F.when(F.col("held"), F.col("year"))).cast("long").alias("years"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of one-series regressions trained outside their hashed holdout."""
    rows = validation.hash_holdout(pairs_of(spark, d), ["pid"], 1 / 3)
    model = rows.where("not held").groupBy("pid").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.avg("y").alias("train_mean"))
    return rows.join(model, "pid").select(F.col("pid").alias("nest_id"), "year", "held", "y", (F.col("intercept") + F.col("slope") * F.col("x")).alias("value"), "train_mean")


SKILL = "count(*) AS n, round(sqrt(avg((y - value) * (y - value))), 6) AS rmse, round(avg(abs(y - value)), 6) AS mae, round(avg(value - y), 6) AS bias, round(stddev_samp(value) / stddev_samp(y), 6) AS sd_ratio, round(1 - sum((y - value) ** 2) / sum((y - train_mean) ** 2), 6) AS re, round(1 - sum((y - value) ** 2) / (var_samp(y) * (count(*) - 1)), 6) AS ce"


@query(f"SELECT nest_id, {SKILL} FROM member WHERE held GROUP BY nest_id", "member")
def holdout_skill(spark, d):
    rows = _members(spark, d).where("held").select("nest_id", F.col("y").alias("observed"), F.col("value").alias("predicted"), F.col("train_mean").alias("calibration_mean"))
    got = validation.skill(rows, ["nest_id"])
    return got.select("nest_id", "n", *[r6(c).alias(c) for c in ("rmse", "mae", "bias", "sd_ratio", "re", "ce")])


@query(f"WITH s AS (SELECT nest_id, {SKILL} FROM member WHERE held GROUP BY nest_id) SELECT count(*) AS runs, round(median(ce), 5) AS median_ce, round(median(re), 5) AS median_re, round(min(ce), 5) AS minimum_ce, round(quantile_cont(ce, 0.05), 5) AS q05_ce, median(ce) > -1 AND median(re) > -1 AS passes FROM s", "member")
def fold_summary(spark, d):
    rows = _members(spark, d).where("held").select("nest_id", F.col("y").alias("observed"), F.col("value").alias("predicted"), F.col("train_mean").alias("calibration_mean"))
    got = validation.skill(rows, ["nest_id"]).agg(F.count(F.lit(1)).alias("runs"), F.median(r6("ce")).alias("ce"), F.median(r6("re")).alias("re"), F.min(r6("ce")).alias("lo"), F.percentile(r6("ce"), F.lit(0.05)).alias("q"))
    return got.select("runs", F.round("ce", 5).alias("median_ce"), F.round("re", 5).alias("median_re"), F.round("lo", 5).alias("minimum_ce"), F.round("q", 5).alias("q05_ce"), filters.passes_gate(F.col("ce"), F.col("re"), -1, -1).alias("passes"))


@query("SELECT year, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.95), 6) AS q95, count(*) AS ensemble_n FROM member GROUP BY year", "member")
def pooled_quantiles(spark, d):
    members = _members(spark, d).select("nest_id", "year", F.array("value").alias("runs"))
    return nests.pool_members(members).select("year", *[r6(q).alias(q) for q in nests.QUANTILES], "ensemble_n")


@query("""WITH m AS (SELECT member.*, k % 4 AS core_count, k % 3 AS start, k % 5 AS stop FROM member JOIN records ON pid = nest_id)
SELECT year, round(value, 6) AS point, count(*) OVER (PARTITION BY year) AS nests FROM m QUALIFY row_number() OVER (PARTITION BY year ORDER BY core_count DESC, start, stop DESC, nest_id) = 1""", "member", "records")
def densest_combination(spark, d):
    k = F.regexp_extract("nest_id", "([0-9]+)", 1).cast("int")
    rows = _members(spark, d).withColumns({"core_count": k % 4, "start": k % 3, "end": k % 5})
    return nests.combine_densest(rows).select("year", r6("point").alias("point"), "nests")


@query("SELECT year, round(median(value), 6) AS point, count(*) AS nests FROM member GROUP BY year", "member")
def median_combination(spark, d):
    return nests.combine_median(_members(spark, d)).select("year", r6("point").alias("point"), "nests")


# folds and summaries


@query("""WITH y AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i, count(*) OVER () AS n FROM target), b AS (SELECT year, i, n, least(34, greatest(2, (n + 2) // 3)) AS w FROM y),
f AS (SELECT year, CASE WHEN n % w = 1 AND n > w AND i // w = (n - 1) // w THEN i // w - 1 ELSE i // w END AS fold FROM b)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS years, min(year) AS first, max(year) AS last FROM f GROUP BY 1""", "target")
def contiguous_folds(spark, d):
    folds = validation.contiguous_folds(supplied.weekly_target(spark, d).select("year"), 34)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("years"), F.min("year").alias("first"), F.max("year").alias("last"))


@query("""WITH y AS (SELECT year, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS n FROM target)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS years, min(year) AS first, max(year) AS last FROM (SELECT 0 AS fold, year FROM y WHERE i <= ceil(n / 3.0) UNION ALL SELECT 1, year FROM y WHERE i > n - ceil(n / 3.0)) GROUP BY 1""", "target")
def edge_folds(spark, d):
    folds = validation.edge_folds(supplied.weekly_target(spark, d).select("year"), 1 / 3)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("years"), F.min("year").alias("first"), F.max("year").alias("last"))


#: Held-out years of both kinds of outer folds, and how they lie among all years.
OUTER = """WITH y AS (SELECT year, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS n FROM target), b AS (SELECT year, i - 1 AS i, n, least(34, greatest(2, (n + 2) // 3)) AS w FROM y),
h AS (SELECT 'blocks' AS kind, CAST(CASE WHEN n % w = 1 AND n > w AND i // w = (n - 1) // w THEN i // w ELSE i // w + 1 END AS INTEGER) AS fold, year FROM b
UNION ALL SELECT 'edges', 1, year FROM y WHERE i <= ceil(n / 3.0) UNION ALL SELECT 'edges', 2, year FROM y WHERE i > n - ceil(n / 3.0)),
o AS (SELECT kind, fold, min(year) AS validation_start, max(year) AS validation_end, CASE WHEN min(year) = (SELECT min(year) FROM y) THEN 'early' WHEN max(year) = (SELECT max(year) FROM y) THEN 'late' ELSE 'middle' END AS holdout_position, count(*) AS held_years, (SELECT count(*) FROM y) - count(*) AS train_years FROM h GROUP BY ALL)
"""


def _outer_folds(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    from .outer import outer_folds

    years = supplied.weekly_target(spark, d).select("year")
    return {kind: outer_folds(years, PCAConfig(), having(ReconstructionConfig(), {"evaluation.outer_folds": kind})) for kind in ("blocks", "edges")}


@query(OUTER + "SELECT * FROM o", "target")
def outer_fold_facts(spark, d):
    """Both kinds of outer folds: what they hold out, where it lies, and what is left to learn from."""
    years = supplied.weekly_target(spark, d).select("year")
    blocks, edges = (validation.outer_fold_table(years, folds).select(F.lit(kind).alias("kind"), "*") for kind, folds in _outer_folds(spark, d).items())
    return blocks.unionByName(edges)


OUTER_SKILL = """, t AS (SELECT kind, fold, pid, regr_slope(p.y, p.x) AS slope, regr_intercept(p.y, p.x) AS intercept, avg(p.y) AS train_mean FROM o, pairs p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.kind = o.kind AND h.fold = o.fold AND h.year = p.year) GROUP BY ALL),
m AS (SELECT h.kind, h.fold, p.pid, p.y, intercept + slope * p.x AS value, train_mean FROM h JOIN pairs p ON p.year = h.year JOIN t ON t.kind = h.kind AND t.fold = h.fold AND t.pid = p.pid),
f AS (SELECT kind, fold, pid, corr(y, value) AS r, sqrt(avg((y - value) ** 2)) AS rmse, 1 - sum((y - value) ** 2) / sum((y - train_mean) ** 2) AS re, 1 - sum((y - value) ** 2) / (var_samp(y) * (count(*) - 1)) AS ce FROM m GROUP BY ALL)
SELECT kind AS validation_mode, pid, count(*) AS fold_count, round(median(r), 6) AS median_r, round(avg(r), 6) AS mean_r, round(min(r), 6) AS minimum_r, round(max(r), 6) AS maximum_r, round(quantile_cont(r, 0.05), 6) AS q05_r, round(quantile_cont(r, 0.95), 6) AS q95_r,
round(median(rmse), 6) AS median_rmse, round(median(re), 6) AS median_re, round(median(ce), 6) AS median_ce, round(median(ce) FILTER (holdout_position = 'early'), 6) AS early_holdout_ce, round(median(r) FILTER (holdout_position = 'late'), 6) AS late_holdout_r FROM f JOIN o USING (kind, fold) GROUP BY ALL"""


@query(OUTER + OUTER_SKILL, "pairs", "target")
def outer_mode_summary(spark, d):
    """Each brand's line judged on outer folds of both kinds; what a fold may learn from is the sums of all years less its own."""
    pairs = pairs_of(spark, d)
    one = [F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(e)).alias(name) for name, e in (("x", "x"), ("y", "y"), ("xx", "x * x"), ("xy", "x * y"))]]
    whole = pairs.groupBy("pid").agg(*one)
    folds = None
    for kind, held in _outer_folds(spark, d).items():
        rows = held.join(pairs, "year")
        own = rows.groupBy("pid", "fold").agg(*[c.alias(f"own_{k}") for c, k in zip(one, ("n", "x", "y", "xx", "xy"), strict=True)])
        left = {k: F.col(k) - F.col(f"own_{k}") for k in ("n", "x", "y", "xx", "xy")}
        lines = own.join(whole, "pid").select("pid", "fold", *[c.alias(f"t_{k}") for k, c in left.items()])
        lines = lines.withColumn("slope", F.expr("(t_n * t_xy - t_x * t_y) / nullif(t_n * t_xx - t_x * t_x, 0)")).withColumns({"intercept": F.expr("(t_y - slope * t_x) / t_n"), "calibration_mean": F.expr("t_y / t_n")})
        told = rows.join(lines, ["pid", "fold"]).select("pid", "fold", F.col("y").alias("observed"), F.expr("intercept + slope * x").alias("predicted"), "calibration_mean")
        facts = validation.outer_fold_table(supplied.weekly_target(spark, d).select("year"), held)
        part = validation.skill(told, ["pid", "fold"]).join(facts, "fold").select(F.lit(kind).alias("validation_mode"), "pid", "fold", "holdout_position", "r", "rmse", "re", "ce")
        folds = part if folds is None else folds.unionByName(part)
    got = validation.summarize_modes(folds, ["validation_mode", "pid"])
    return got.select("validation_mode", "pid", "fold_count", *[r6(c).alias(c) for c in ("median_r", "mean_r", "minimum_r", "maximum_r", "q05_r", "q95_r", "median_rmse", "median_re", "median_ce", "early_holdout_ce", "late_holdout_r")])


@query("""SELECT pid AS nest_id, count(*) AS n, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse, round(avg(abs(y - x)), 6) AS mae, round(avg(x - y), 6) AS bias, round(stddev_samp(y), 6) AS observed_sd, round(stddev_samp(x), 6) AS predicted_sd,
round(1 - sum((y - x) ** 2) / (var_samp(y) * (count(*) - 1)), 6) AS ce, round(corr(x, y), 6) AS r FROM pairs GROUP BY pid""", "pairs")
def skill_metrics(spark, d):
    rows = pairs_of(spark, d).select(F.col("pid").alias("nest_id"), F.col("y").alias("observed"), F.col("x").alias("predicted"), F.lit(None).cast("double").alias("calibration_mean"))
    got = validation.skill(rows, ["nest_id"])
    return got.select("nest_id", "n", *[r6(c).alias(c) for c in ("rmse", "mae", "bias", "observed_sd", "predicted_sd", "ce", "r")])


@query("""WITH l AS (SELECT 'x' AS metric, x AS v FROM pairs UNION ALL SELECT 'y', y FROM pairs)
SELECT metric, count(v) AS n, round(min(v), 6) AS minimum, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.95), 6) AS q95, round(max(v), 6) AS maximum FROM l GROUP BY metric""", "pairs")
def sensitivity_summary(spark, d):
    got = validation.summarize(pairs_of(spark, d).select("x", "y"), ["x", "y"])
    return got.select("metric", "n", *[r6(c).alias(c) for c in ("minimum", "q05", "q25", "median", "q75", "q95", "maximum")])


@query("SELECT p.pid AS omitted, count(*) AS kept FROM records p JOIN records q ON p.pid <> q.pid GROUP BY 1", "records")
def leave_one_out_membership(spark, d):
    rec = supplied.records(spark, d).select("pid")
    return validation.leave_one_out(rec).groupBy("omitted").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH r AS (SELECT CAST(run AS INTEGER) AS run, pid, row_number() OVER (PARTITION BY run ORDER BY md5(run || ':' || pid), pid) AS i, count(*) OVER (PARTITION BY run) AS n FROM records CROSS JOIN range(0, 3) t(run))
SELECT run, string_agg(pid, '|' ORDER BY pid) AS pids FROM r WHERE i <= greatest(2, ceil(n * 0.8)) GROUP BY run""", "records")
def random_deletion_membership(spark, d):
    got = validation.random_deletion(supplied.records(spark, d).select("pid"), 3, 0.2)
    return got.groupBy("run").agg(F.array_join(F.array_sort(F.collect_list("pid")), "|").alias("pids"))


@query("SELECT a.n, round(corr(a.x, b.x), 6) AS r, round(sqrt(avg((a.x - b.x) ** 2)), 6) AS rmse, round(avg(a.x - b.x), 6) AS bias, round(max(abs(a.x - b.x)), 6) AS largest FROM (SELECT count(*) OVER () AS n, year, x FROM (SELECT year, avg(value) AS x FROM annual GROUP BY 1)) a JOIN (SELECT year, median(value) AS x FROM annual GROUP BY 1) b USING (year) GROUP BY a.n", "annual")
def compare_reconstructions(spark, d):
    a = annual_of(spark, d).groupBy("year").agg(F.avg("value").alias("value"))
    b = annual_of(spark, d).groupBy("year").agg(F.median("value").alias("value"))
    got = validation.compare(a, b)
    return got.select("n", *[r6(c).alias(c) for c in ("r", "rmse", "bias", "largest")])


@query("SELECT year, round(coalesce(a.x, b.x), 6) AS value FROM (SELECT year, avg(value) AS x FROM annual WHERE year % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT year, y AS x FROM target) b USING (year)", "annual", "target")
def coalescing_join(spark, d):
    a = annual_of(spark, d).where("year % 2 = 0").groupBy("year").agg(F.avg("value").alias("value"))
    return validation.combine_first(a, supplied.weekly_target(spark, d).select("year", F.col("y").alias("value"))).select("year", r6("value").alias("value"))


@query("SELECT sha256(string_agg(pid || ':' || resolution, ',' ORDER BY pid)) AS digest FROM res", "res")
def table_digest(spark, d):
    rows = temporal.native_resolution(supplied.weekly(spark, d)).select(F.concat_ws(":", "pid", F.col("resolution").cast("string")).alias("x"), "pid")
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", "x"))), lambda s: s["x"]), ","), 256).alias("digest"))


