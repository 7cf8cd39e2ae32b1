"""Results as tables in a folder, with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from ..config import to_json


def flat(df: DataFrame) -> DataFrame:
    """Arrays and maps as text, for CSV."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, ArrayType):
            out = out.withColumn(f.name, F.array_join(F.col(f.name).cast("array<string>"), "|"))
        elif isinstance(f.dataType, MapType):
            out = out.withColumn(f.name, F.to_json(f.name))
    return out


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A compact table: one file, as it has a row for each series, nest or year at most."""
    if kind == "csv":
        flat(df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def source_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a source."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def table_digest(df: DataFrame, *columns: Column | str) -> DataFrame:
    """An order-free digest of a table: its rows' count and the sum of their hashes."""
    named = columns or df.columns
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*named).cast("decimal(38,0)")).alias("digest"))


def save(result, directory: str, inputs: dict[str, str] | None = None) -> dict:
    """Write what the output settings ask for; returns the manifest, which is written too. Empty tables are left out."""
    from ..plans.pipeline import primary_summary

    out = result.config.output
    made = result.reconstruction
    tables: dict[str, DataFrame | None] = {}
    if out.save_screening:
        tables |= {"series_screening": result.screening, "source_qc": result.decisions, "source_rejects": result.rejects, "dropped_duplicates": result.dropped, "duplicate_groups": result.duplicate_groups}
    if out.save_reconstruction:
        tables |= {"reconstruction": made.series.orderBy("year")}
    if out.save_metrics:
        tables |= {"observation_fit": result.observation_fit, "primary_summary": primary_summary(result), "nest_summary": made.nests.orderBy(F.col("median_ce").asc_nulls_first()), "model_selection": made.selection, "resolution_layers": made.layers, "series_weights": made.weights, "availability": made.availability, "sensitivity": result.sensitivity}
        filled = made.annual.groupBy("pid").agg(F.sum(F.col("is_native").cast("long")).alias("native_years"), F.sum(F.col("is_interpolated").cast("long")).alias("interpolated_years"))
        tables |= {"interpolation_audit": filled, "low_frequency_constraints": made.constraints, "low_frequency_observations": made.observations, "multiresolution_selection": made.slow_selection}
        if out.show_external:
            tables |= {"validation_folds": result.validation_folds, "validation_summary": result.validation_summary}
    counts = {}
    for name, df in tables.items():
        if df is not None and not df.isEmpty():
            write_table(df, f"{directory}/{name}")
            counts[name] = df.count()
    if result.validation_folds is not None and out.show_external:
        flat(result.validation_folds).write.mode("overwrite").partitionBy("validation_mode").option("header", True).csv(f"{directory}/validation_by_mode")
    spark = made.series.sparkSession
    manifest = {"tables": counts, "inputs": {k: [r.asDict() for r in source_digest(spark, p).collect()] for k, p in (inputs or {}).items()}, "config": to_json(result.config)}
    spark.createDataFrame([(json.dumps(manifest, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory}/manifest")
    return manifest


def save_deduplicated(kept: DataFrame, dropped: DataFrame, groups: DataFrame, directory: str) -> None:
    write_table(kept, f"{directory}/deduplicated", "parquet")
    write_table(dropped, f"{directory}/dropped_duplicates")
    write_table(groups, f"{directory}/duplicate_groups")


def place_table(screening: DataFrame) -> DataFrame:
    """What a map of the series shows."""
    return screening.select("pid", "lat", "lon", "archive", "selected", "r")
