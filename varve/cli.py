"""Command line: ``python -m varve.cli deduplicate SOURCE OUT`` or ``run SOURCE OBSERVATIONS [--config FILE] [--out DIR]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .config import PipelineConfig, load_config
from .operators import dedup
from .plans.pipeline import _source_facts, run_pipeline
from .sources import series, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="varve")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("deduplicate", help="remove exact and rounding-equivalent copies of series")
    d.add_argument("source")
    d.add_argument("out")
    r = sub.add_parser("run", help="run the whole workflow")
    r.add_argument("source")
    r.add_argument("observations")
    r.add_argument("--config")
    r.add_argument("--out")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("varve").getOrCreate()
    source = series.load_database(spark, args.source)
    if args.command == "deduplicate":
        read = series.load_series(source)
        kept, dropped, groups = dedup.deduplicate(_source_facts(source), read.observations)
        rows = source.withColumn("__pid", source["datasetId"].cast("string")).join(kept.select(kept["pid"].alias("__pid")), "__pid", "left_semi").drop("__pid")
        sinks.save_deduplicated(rows, dropped, groups, args.out)
        print(json.dumps({"kept": rows.count(), "dropped": dropped.count(), "groups": groups.count()}))
        return 0
    config = load_config(args.config) if args.config else PipelineConfig()
    observations = spark.read.option("header", True).csv(args.observations) if args.observations.endswith(".csv") else spark.read.parquet(args.observations)
    result = run_pipeline(source, observations, config)
    manifest = sinks.save(result, args.out or config.output.directory, {"source": args.source, "observations": args.observations})
    print(json.dumps(manifest["tables"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
