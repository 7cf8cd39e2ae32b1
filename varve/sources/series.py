"""Source tables of series and observations as tidy tables.

A nested source has one row per series with array cells; a compact source has the columns pid, time,
value and ptype. Both become records (pid, lat, lon, elev, archive, proxy, metadata) and observations
(pid, time, value). A series without any finite sample goes to a table of rejects instead of stopping
the read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.stats import number
from ..operators.temporal import ALL_MONTHS, clean_observations, required_months, season_year

#: Labels of years before 1950.
BEFORE_PRESENT = ("bp", "yr bp", "years bp", "cal bp", "cal yr bp")
#: Month names and their abbreviations.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


@dataclass
class Series:
    records: DataFrame
    observations: DataFrame
    rejects: DataFrame


def parse_array(c: Column, kind=None) -> Column:
    """An array cell as array<double>; text in brackets or parentheses is parsed, bad elements are NULL."""
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: number(x.cast("string"))) if not isinstance(kind.elementType, StringType) else F.transform(c, number)
    text = F.trim(c.cast("string"))
    inner = F.regexp_replace(text, r"^[\[(]|[\])]$", "")
    return F.when(F.trim(inner) == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, r"\s*,\s*"), number))


def common_era(time: Column, unit: Column) -> Column:
    return F.when(F.lower(F.trim(unit)).isin(*BEFORE_PRESENT), 1950.0 - time).otherwise(time)


def metadata_map(df: DataFrame, excluded: Sequence[str]) -> Column:
    """The other columns that are no arrays as a map of texts; empty ones are left out."""
    names = [f.name for f in df.schema.fields if f.name not in excluded and not isinstance(f.dataType, ArrayType)]
    if not names:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def _text(df: DataFrame, *names: str, default: str = "unknown") -> Column:
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default))


def _number(df: DataFrame, name: str) -> Column:
    return number(F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("double")


def read_nested(df: DataFrame, columns: dict[str, str] | None = None) -> Series:
    """Rows with array cells ``year`` and ``paleoData_values``; lengths that differ are an error."""
    name = {"time": "year", "value": "paleoData_values", "unit": "yearUnits", "archive": "archiveType", "proxy": "paleoData_proxy", "lat": "geo_meanLat", "lon": "geo_meanLon", "elev": "geo_meanElev"} | (columns or {})
    ids = [F.col(c).cast("string") for c in ("datasetId", "dataSetName") if c in df.columns]
    rows = df.withColumn("pid", F.trim(F.coalesce(*ids)))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    times, values = parse_array(F.col(name["time"]), kinds[name["time"]]), parse_array(F.col(name["value"]), kinds[name["value"]])
    rows = rows.withColumns({"__t": times, "__v": values})
    rows = rows.withColumn("__t", F.when(F.size("__t") == F.size("__v"), F.col("__t")).otherwise(F.raise_error(F.concat("pid", F.lit(": time and value lengths differ")))))
    unit = F.col(name["unit"]).cast("string") if name["unit"] in df.columns else F.lit("")
    pairs = rows.select("pid", unit.alias("unit"), F.explode(F.arrays_zip("__t", "__v")).alias("s"))
    obs = clean_observations(pairs.select("pid", common_era(F.col("s.__t"), F.col("unit")).alias("time"), F.col("s.__v").alias("value")))
    records = rows.select(
        "pid", _number(df, name["lat"]).alias("lat"), _number(df, name["lon"]).alias("lon"), _number(df, name["elev"]).alias("elev"),
        _text(df, name["archive"]).alias("archive"), _text(df, name["proxy"]).alias("proxy"), metadata_map(df, [name["time"], name["value"]]).alias("metadata"),
    )
    return _split(records, obs)


def read_compact(df: DataFrame) -> Series:
    """Rows (pid, time, value, lat, lon, elev, ptype), array cells or one sample a row; the archive is what ptype has before its dot."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(kinds["time"], ArrayType):
        pairs = df.select("pid", F.explode(F.arrays_zip(parse_array(F.col("time"), kinds["time"]).alias("t"), parse_array(F.col("value"), kinds["value"]).alias("v"))).alias("s")).select("pid", F.col("s.t").alias("time"), F.col("s.v").alias("value"))
    else:
        pairs = df.select("pid", number(F.col("time").cast("string")).alias("time"), number(F.col("value").cast("string")).alias("value"))
    archive = F.coalesce(F.nullif(F.trim(F.col("archive")), F.lit("")), F.lit(None)) if "archive" in df.columns else F.lit(None).cast("string")
    prefix = F.nullif(F.split_part(F.col("ptype"), F.lit("."), F.lit(1)), F.lit("")) if "ptype" in df.columns else F.lit(None).cast("string")
    records = df.select(
        "pid", _number(df, "lat").alias("lat"), _number(df, "lon").alias("lon"), _number(df, "elev").alias("elev"), F.coalesce(archive, prefix, F.lit("unknown")).alias("archive"),
        _text(df, "proxy", "ptype").alias("proxy"), metadata_map(df, ["time", "value"]).alias("metadata"),
    )
    return _split(records.dropDuplicates(["pid"]), clean_observations(pairs))


def _split(records: DataFrame, obs: DataFrame) -> Series:
    have = obs.select("pid").distinct()
    return Series(records.join(have, "pid", "left_semi"), obs, records.join(have, "pid", "left_anti"))


def load_series(df: DataFrame) -> Series:
    """Whichever kind of source the columns tell."""
    have = set(df.columns)
    if {"year", "paleoData_values", "datasetId"} <= have:
        return read_nested(df)
    if {"pid", "time", "value"} <= have:
        return read_compact(df)
    raise ValueError("unknown source: it needs year, paleoData_values and datasetId, or pid, time and value")


def load_database(spark: SparkSession, path: str) -> DataFrame:
    """A source table from Parquet, or from a pickled frame (of a trusted local file only)."""
    if path.endswith((".pkl", ".pickle")):
        frame = pd.read_pickle(path)
        for c in ("year", "paleoData_values", "time", "value"):
            if c in frame and frame[c].map(lambda x: hasattr(x, "__len__") and not isinstance(x, str)).any():
                frame[c] = frame[c].map(lambda x: x if isinstance(x, str) else [float(v) for v in x])
        return spark.createDataFrame(frame)
    return spark.read.parquet(path)


def load_series_files(spark: SparkSession, path: str, time: str = "Year", value: str = "Value") -> DataFrame:
    """(pid, time, value) of a folder of CSV files, one series a file; without the named columns the first two count."""
    df = spark.read.option("header", True).csv(path)
    t, v = (time, value) if {time, value} <= set(df.columns) else df.columns[:2]
    pid = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1)
    return clean_observations(df.select(pid.alias("pid"), number(F.col(t)).alias("time"), number(F.col(v)).alias("value")))


def month_number(name: str) -> int | None:
    low = name.strip().lower()
    return next((k for k, m in enumerate(MONTHS, 1) if low in (m, m[:3])), None)


def monthly_target(df: DataFrame, year: str, months: Sequence[int] = ALL_MONTHS, anchor: str = "end", fraction: float = 0.75) -> DataFrame:
    """(year, y) of a wide monthly table: means over the season where enough months have a value."""
    columns = {c: k for c in df.columns if (k := month_number(c))}
    if not columns:
        raise ValueError("no month columns")
    wide = df.select(number(F.col(year).cast("string")).alias("year"), *[number(F.col(c).cast("string")).alias(c) for c in columns])
    long = wide.unpivot(["year"], list(columns), "name", "value").dropna()
    lookup = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    long = long.withColumn("month", F.element_at(lookup, F.col("name"))).where(F.col("month").isin(*months))
    long = long.withColumn("year", season_year(F.col("year").cast("int"), F.col("month"), tuple(months), anchor))
    out = long.groupBy("year").agg(F.avg("value").alias("y"), F.count_distinct("month").alias("m"))
    return out.where(F.col("m") >= required_months(months, fraction)).select("year", "y")


def load_observations(source: DataFrame, year: str = "Year", value: str | None = None, months: Sequence[int] = ALL_MONTHS, anchor: str = "end", fraction: float = 0.75) -> DataFrame:
    """(year, y) of an annual or monthly table of observations."""
    year = year if year in source.columns else source.columns[0]
    if any(month_number(c) for c in source.columns if c != year):
        return monthly_target(source, year, months, anchor, fraction)
    if value is None:
        others = [c for c in source.columns if c != year]
        if len(others) != 1:
            raise ValueError("name the value column of a table with several")
        value = others[0]
    rows = source.select(number(F.col(year).cast("string")).alias("t"), number(F.col(value).cast("string")).alias("v")).dropna()
    return rows.groupBy(F.floor("t").cast("int").alias("year")).agg(F.avg("v").alias("y"))


def read_observations(spark: SparkSession, path: str, **options) -> DataFrame:
    """Observations of a CSV or Parquet file."""
    if path.endswith(".csv"):
        return load_observations(spark.read.option("header", True).csv(path), **options)
    if path.endswith(".parquet"):
        return load_observations(spark.read.parquet(path), **options)
    raise ValueError("observations are read from .csv or .parquet")


