"""Curate an archive of texts: find copies, keep the most complete of each, and give every row a decision with its reasons.

    python -m jobs.curate_texts --source IN/documents.parquet --output OUT [--config jobs/curate_texts.json]

The output is one table, OUT/archive, partitioned by decision (kept, dropped) and language, with the columns
of the source, the digest of the text, the size of its group of copies, the row that is kept of it, and the
reasons joined by |, in this order: empty_text, language, too_short, copy. A second run overwrites it with
the same rows.

Copies are texts that are equal but for white space. Of a group the row with most columns filled stays, then
the smallest doc_id, language, source and text. Rows that are equal in all columns are one record read twice
and count once. A null or blank text has no group. A null or empty language is in the partition ``unknown``.
Columns beyond doc_id, text, lang, source and n_chars are carried along, unless they have the name of an
added one, which replaces them.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.settings import load
from varve.operators.dedup import completeness
from varve.operators.filters import one_of

log = logging.getLogger(__name__)

ADDED = ("digest", "group_size", "keep_id", "reasons", "decision", "language")


@dataclass(frozen=True)
class CurateConfig:
    languages: tuple[str, ...] = ()
    least_chars: int = 0


def copies(docs: DataFrame) -> DataFrame:
    """docs with digest, group_size and best (whether the row is the one that stays).

    Rows with their texts move once, by the hash of what they are ordered by but for completeness and text: equal
    rows meet there, and so do the rows of which the text decides. What a group is, is found from hashes.
    """
    plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    near = F.struct(
        (-completeness(docs, ("doc_id", "text"))).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").cast("long").alias("c"), F.coalesce("lang", F.lit("")).alias("d"), F.coalesce("source", F.lit("")).alias("e")
    )
    order = F.struct(near.alias("a"), F.coalesce("text", F.lit("")).alias("b"), F.coalesce(F.col("n_chars").cast("long"), F.lit(-1)).alias("c"))
    # never null, so that joins add no filter that makes the hashes again
    hashed = lambda *c: F.coalesce(F.unhex(F.sha2(F.to_json(F.struct(*c)), 256)), F.lit(b""))
    keyed = docs.withColumn("digest", F.when(plain != "", F.sha2(plain, 256)))
    keyed = keyed.withColumn("__key", hashed("digest", "doc_id", F.coalesce("lang", F.lit("")).alias("d"), F.coalesce("source", F.lit("")).alias("e")))
    keyed = keyed.withColumn("__record", hashed(F.sha2("text", 256).alias("text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")))

    # a row without a digest is a group of its own
    group = F.coalesce("digest", F.lower(F.hex("__record"))).alias("__group")
    narrow = keyed.select("__key", "__record", group, "doc_id", near.alias("__near")).repartition("__key").distinct()
    places = narrow.groupBy("__key", "__group").agg(F.count(F.lit(1)).alias("__here"), F.min(F.struct("__near", "doc_id")).alias("__mine"))
    groups = places.groupBy("__group").agg(F.sum("__here").alias("__n"), F.min("__mine").alias("__first")).where("__n > 1")
    # both sides of the join need the same columns of places and so share what is moved for them
    grouped = places.join(groups, "__group").where("__n >= __here AND __mine >= __first").select("__key", "__n", "__first")

    # a window, as an aggregate would sort or hash the texts once more
    again = F.row_number().over(Window.partitionBy("__key", "__record").orderBy("__record"))
    rows = keyed.repartition("__key").withColumn("__again", again).where("__again = 1")
    rows = rows.withColumn("__own", F.min(order).over(Window.partitionBy("__key")) == order)
    joined = rows.join(grouped, "__key", "left")
    size = F.when(F.col("digest").isNotNull(), F.coalesce("__n", F.lit(1)))
    best = F.col("__first").isNull() | (F.col("__own") & near.eqNullSafe(F.col("__first.__near")))
    keep = F.when(F.col("digest").isNotNull(), F.when(F.col("__first").isNull(), F.col("doc_id")).otherwise(F.col("__first.doc_id")))
    return joined.withColumns({"group_size": size, "keep_id": keep, "best": best}).drop("__key", "__record", "__again", "__own", "__n", "__first")


def decide(docs: DataFrame, cfg: CurateConfig) -> DataFrame:
    """docs with the columns ADDED."""
    rows = copies(docs.drop(*ADDED))
    checks = [("empty_text", F.col("digest").isNull()), ("language", ~one_of(F.col("lang"), cfg.languages)), ("too_short", F.length(F.coalesce("text", F.lit(""))) < cfg.least_chars), ("copy", ~F.col("best"))]
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    rows = rows.withColumn("reasons", F.array_join(reasons, "|"))
    language = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("unknown"))
    return rows.withColumns({"decision": F.when(F.col("reasons") == "", "kept").otherwise("dropped"), "language": language}).drop("best")


def run(spark: SparkSession, source: str, output: str, cfg: CurateConfig = CurateConfig()) -> DataFrame:
    """Write OUT/archive and return it as it is read back."""
    docs = spark.read.parquet(source)
    made = decide(docs, cfg)
    path = f"{output.rstrip('/')}/archive"
    made.write.mode("overwrite").partitionBy("decision", "language").parquet(path)
    # partition values are texts, whatever they look like
    got = spark.read.schema(made.schema).parquet(path)
    log.info("read %s rows from %s", docs.count(), source)
    for r in got.groupBy("decision", "reasons").count().orderBy("decision", "reasons").collect():
        log.info("%s rows %s %s", r["count"], r["decision"], r["reasons"])
    return got


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.curate_texts", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("source", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("curate_texts").getOrCreate()
    try:
        cfg = load(spark, args.config, CurateConfig) if args.config else CurateConfig()
        run(spark, args.source, args.output, cfg)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
