"""The jobs over the supplied tables, each run twice into one new folder, with the SQL of what they leave."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions.storage import shared_folder

from . import curate_texts, ingest_samples

EVENTS = ingest_samples.IngestConfig(series="concat('u', user_id % 20, '-', event_type)", time="(unix_timestamp(ts) - 1704067200) / 3600.0", value="value", width=24, span=10)
TEXTS = curate_texts.CurateConfig(languages=("en", "de", "fr"), least_chars=40)


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_ingest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "ingest")
    source = f"{sf_dir.rstrip('/')}/events.parque[t]"  # a pattern, as the table is a file here and a folder there
    for _ in range(2):
        got = ingest_samples.run(spark, source, f"{folder}/out", f"{folder}/checkpoint", EVENTS)
    # samples have two places: beyond the eighth, their means end in a five only where 256 of them meet
    rounded = lambda c, k: F.round(c, k).alias(c)
    return got.select("pid", "window_id", "samples", rounded("mean", 9), "minimum", "maximum", rounded("first_time", 6), rounded("last_time", 6), "span")


def job2_curate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "curate")
    for _ in range(2):
        got = curate_texts.run(spark, f"{sf_dir.rstrip('/')}/documents.parquet", folder, TEXTS)
    return got


INGEST_SQL = """WITH s AS (SELECT 'u' || (user_id % 20) || '-' || event_type AS pid, CAST(floor(epoch(ts)) - 1704067200 AS DOUBLE) / 3600.0 AS time, value FROM events),
w AS (SELECT *, CAST(floor((time + 0.5) / 24) * 24 AS INTEGER) AS window_id FROM s WHERE pid IS NOT NULL AND time IS NOT NULL AND isfinite(value))
SELECT pid, window_id, count(*) AS samples, round(CAST(sum(CAST(value AS DECIMAL(28,10))) AS DOUBLE) / count(*), 9) AS mean, min(value) AS minimum, max(value) AS maximum, round(min(time), 6) AS first_time, round(max(time), 6) AS last_time, CAST(floor(window_id / 240.0) AS INTEGER) AS span
FROM w GROUP BY pid, window_id"""

CURATE_SQL = r"""WITH d AS (SELECT DISTINCT doc_id, text, lang, source, n_chars FROM documents),
p AS (SELECT *, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain, CAST(lang IS NOT NULL AS INTEGER) + CAST(source IS NOT NULL AS INTEGER) + CAST(n_chars IS NOT NULL AS INTEGER) AS filled FROM d),
g AS (SELECT *, CASE WHEN plain <> '' THEN sha256(plain) END AS digest FROM p),
r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS first_id, count(*) OVER (PARTITION BY digest) AS n FROM g WINDOW w AS (PARTITION BY digest ORDER BY filled DESC, doc_id NULLS LAST, coalesce(lang, ''), coalesce(source, ''), text, coalesce(n_chars, -1))),
f AS (SELECT *, concat_ws('|', CASE WHEN digest IS NULL THEN 'empty_text' END, CASE WHEN coalesce(lower(trim(lang)) NOT IN ('en', 'de', 'fr'), true) THEN 'language' END, CASE WHEN length(coalesce(text, '')) < 40 THEN 'too_short' END, CASE WHEN digest IS NOT NULL AND place > 1 THEN 'copy' END) AS reasons FROM r)
SELECT doc_id, text, lang, source, n_chars, digest, CASE WHEN digest IS NOT NULL THEN n END AS group_size, CASE WHEN digest IS NOT NULL THEN first_id END AS keep_id, reasons, CASE WHEN reasons = '' THEN 'kept' ELSE 'dropped' END AS decision, coalesce(nullif(lower(trim(lang)), ''), 'unknown') AS language FROM f"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_ingest_samples, job2_curate_texts)}


def oracle_sql() -> dict[str, str]:
    return {"job1_ingest_samples": INGEST_SQL, "job2_curate_texts": CURATE_SQL}
