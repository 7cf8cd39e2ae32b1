"""Keep window means of many series up to date as files of samples arrive.

    python -m jobs.ingest_samples --source 'IN/*.parquet' --output OUT --checkpoint CHECKPOINT [--config jobs/ingest_samples.json]

Each run takes the files that no earlier run with the same checkpoint took (a file stream that ends when
it has them all) and leaves

    OUT/parts   span=, batch=     sums of each batch by series and window; rejected samples by reason
    OUT/means   span=             pid, window_id, samples, mean, minimum, maximum, first_time, last_time

A batch overwrites its own partitions of ``parts``, and then the spans of ``means`` that it touched, made
anew from all their parts. So a batch that is repeated after a failure changes nothing, and a run without
new files leaves all as it is. Sums are decimals, so their order makes no difference either.

A sample without a series, a time or a finite value is rejected and counted under its reason. Files may
have further columns. Repeated samples count as often as they come.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import load
from varve.operators.temporal import window_of

log = logging.getLogger(__name__)

PARTS = "pid string, window_id int, reason string, samples long, total decimal(38,10), minimum double, maximum double, first_time double, last_time double, span int, batch long"
MEANS = "pid string, window_id int, samples long, mean double, minimum double, maximum double, first_time double, last_time double, span int"


@dataclass(frozen=True)
class IngestConfig:
    """SQL expressions over the files' columns for series, time and value; windows of ``width`` from ``start`` on, ``span`` of them a partition.

    ``columns`` is the files' schema as DDL; without it, it is read from the files that are there.
    """

    series: str = "pid"
    time: str = "time"
    value: str = "value"
    start: int = 0
    width: int = 1
    span: int = 100
    format: str = "parquet"
    columns: str = ""
    files_per_batch: int = 1000


def judged(rows: DataFrame, cfg: IngestConfig) -> DataFrame:
    """pid, time, value and the reason why a sample is rejected, NULL if it is not."""
    rows = rows.select(F.expr(cfg.series).cast("string").alias("pid"), F.expr(cfg.time).cast("double").alias("time"), F.expr(cfg.value).cast("double").alias("value"))
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)
    reason = F.when(F.col("pid").isNull(), "no_series").when(~finite(F.col("time")), "no_time").when(~finite(F.col("value")), "no_value")
    return rows.withColumn("reason", reason)


def span_of(window: Column, cfg: IngestConfig) -> Column:
    return F.floor((window - cfg.start) / (cfg.width * cfg.span)).cast("int")


def batch_parts(rows: DataFrame, cfg: IngestConfig) -> DataFrame:
    """One row for each series and window, or reason, of a batch."""
    rows = judged(rows, cfg)
    fine = F.col("reason").isNull()
    rows = rows.select(*[F.when(fine, F.col(c)).alias(c) for c in ("pid", "time", "value")], "reason")
    rows = rows.withColumn("window_id", window_of(F.col("time"), cfg.start, cfg.width).cast("int"))
    sums = rows.groupBy("pid", "window_id", "reason").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("value").cast("decimal(28,10)")).alias("total"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.min("time").alias("first_time"), F.max("time").alias("last_time"),
    )
    return sums.withColumn("span", span_of(F.col("window_id"), cfg))


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def take_batch(rows: DataFrame, batch: int, output: str, cfg: IngestConfig) -> None:
    """Write a batch's parts, and the means of the spans it touched."""
    spark = rows.sparkSession
    replace_partitions(batch_parts(rows, cfg).withColumn("batch", F.lit(batch).cast("long")), f"{output}/parts", "span", "batch")
    parts = spark.read.schema(PARTS).parquet(f"{output}/parts")
    own = parts.where(F.col("batch") == batch)
    for r in own.groupBy("reason").agg(F.sum("samples").alias("n")).collect():
        log.info("batch %s: %s samples %s", batch, r["n"], "taken" if r["reason"] is None else f"rejected: {r['reason']}")
    touched = parts.where("reason IS NULL").join(own.where("reason IS NULL").select("span").distinct(), "span", "left_semi")
    means = touched.groupBy("span", "pid", "window_id").agg(
        F.sum("samples").alias("samples"), (F.sum("total").cast("double") / F.sum("samples")).alias("mean"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
    )
    replace_partitions(means.repartition("span"), f"{output}/means", "span")


def read_means(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(MEANS).parquet(f"{output}/means")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """Take what is new in ``source`` (a folder or a pattern) and return the means as they stand then."""
    output = output.rstrip("/")
    # so that there is a table to read even where no sample has come
    spark.createDataFrame([], MEANS).write.mode("append").partitionBy("span").parquet(f"{output}/means")
    schema = cfg.columns or spark.read.format(cfg.format).load(source).schema
    stream = spark.readStream.format(cfg.format).schema(schema).option("maxFilesPerTrigger", cfg.files_per_batch).load(source)
    query = stream.writeStream.foreachBatch(lambda rows, batch: take_batch(rows, batch, output, cfg)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    new = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %s new rows from %s; means are in %s/means", new, source, output)
    return read_means(spark, output)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.ingest_samples", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("source", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("ingest_samples").getOrCreate()
    try:
        cfg = load(spark, args.config, IngestConfig) if args.config else IngestConfig()
        log.info("%s windows", run(spark, args.source, args.output, args.checkpoint, cfg).count())
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
