"""The jobs on copies: growing input, repeated batches, failures, odd rows, command lines."""

import os
import random
import subprocess
import sys
from collections import defaultdict

import duckdb
import pytest
from pyspark.errors import StreamingQueryException

from jobs import curate_texts, ingest_samples, queries
from jobs.curate_texts import CurateConfig
from jobs.ingest_samples import IngestConfig
from jobs.settings import load

SMALL = "/root/testdata/sf0.001"
COLUMNS = "pid string, time double, value double, extra string, reason string"
CFG = IngestConfig(width=5, span=4, columns=COLUMNS)


def samples(seed, n=300):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(6)}", rng.uniform(-40, 200), rng.gauss(0, 3), "x", "y") for _ in range(n)]
    return rows + [(None, 1.0, 2.0, "x", None), ("s1", None, 2.0, "x", None), ("s1", float("nan"), 1.0, None, None), ("s1", 3.0, float("inf"), None, None), ("s2", 4.0, None, None, None), rows[0], rows[0]]


def expected(rows):
    groups = defaultdict(list)
    for pid, t, v, *_ in rows:
        if pid is not None and t is not None and t == t and v is not None and abs(v) < float("inf"):
            groups[pid, int((t + 0.5) // 5) * 5].append((t, v))
    return {k: (len(g), round(sum(v for _, v in g) / len(g), 6), min(v for _, v in g), max(v for _, v in g), min(t for t, _ in g), max(t for t, _ in g), k[1] // 20) for k, g in groups.items()}


def found(df):
    rows = df.collect()
    got = {(r.pid, r.window_id): (r.samples, round(r["mean"], 6), r.minimum, r.maximum, r.first_time, r.last_time, r.span) for r in rows}
    assert len(got) == len(rows)
    return got


def put(spark, rows, folder):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_takes_only_what_is_new(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first, second = samples(1), samples(2)
    taken = []
    plain = ingest_samples.take_batch
    monkeypatch.setattr(ingest_samples, "take_batch", lambda rows, k, *a: (taken.append(rows.count()), plain(rows, k, *a)))
    put(spark, first, source)
    assert found(ingest_samples.run(spark, source, out, mark, CFG)) == expected(first)
    put(spark, second, source)
    assert found(ingest_samples.run(spark, source, out, mark, CFG)) == expected(first + second)
    assert found(ingest_samples.run(spark, source, out, mark, CFG)) == expected(first + second)
    assert [n for n in taken if n] == [len(first), len(second)]
    # a batch that comes again changes nothing
    plain(spark.read.schema(COLUMNS).parquet(source).limit(0).unionByName(spark.createDataFrame(second, COLUMNS)), 1, out, CFG)
    assert found(ingest_samples.read_means(spark, out)) == expected(first + second)
    parts = spark.read.schema(ingest_samples.PARTS).parquet(f"{out}/parts")
    rejected = {r.reason: r.n for r in parts.where("reason is not null").groupBy("reason").agg({"samples": "sum"}).withColumnRenamed("sum(samples)", "n").collect()}
    assert rejected == {"no_series": 2, "no_time": 4, "no_value": 4}
    assert {d for d in os.listdir(f"{out}/means") if d.startswith("span=")} == {f"span={k}" for k in {v[-1] for v in expected(first + second).values()}}


def test_ingest_survives_a_failure_between_its_tables(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = samples(3)
    put(spark, rows, source)
    plain = ingest_samples.replace_partitions

    def fails(df, path, *keys):
        if path.endswith("means"):
            raise RuntimeError("lost")
        plain(df, path, *keys)

    monkeypatch.setattr(ingest_samples, "replace_partitions", fails)
    with pytest.raises(StreamingQueryException):
        ingest_samples.run(spark, source, out, mark, CFG)
    monkeypatch.setattr(ingest_samples, "replace_partitions", plain)
    assert found(ingest_samples.run(spark, source, out, mark, CFG)) == expected(rows)


def test_ingest_without_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = ingest_samples.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), CFG)
    assert got.count() == 0
    put(spark, [], str(tmp_path / "in"))
    assert ingest_samples.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), CFG).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "one  two\tthree", "en", "a", 14), (2, " one two three", "en", None, 14), (3, "one two three\n", "en", "a", 14), (3, "one two three\n", "en", "a", 14), (None, "one two three", "en", "a", 13),
    (4, None, "en", "a", None), (5, "", None, "a", 0), (6, " \n", "", None, 2), (7, "allein", " EN ", "a", 6), (8, "otra cosa aqui", "es", "b", 14), (9, "otra  cosa aqui", "en", "b", 15), (None, None, None, None, None), (None, None, None, None, None),
    (10, "no language at all here", None, None, None), (11, "ünï cödé text", "en", "c", 13), (11, "ünï cödé text", "de", "c", 13), (11, "ünï cödé text", "de", "b", 13),
]


@pytest.mark.parametrize("copies", [1, 40])
def test_curate_equals_sql_and_runs_again(spark, tmp_path, copies):
    docs = spark.createDataFrame(ODD * copies + [(k + 100, "hot text that many rows share, over and over again", "fr", "s", k) for k in range(60)], DOCS)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.write.parquet(source)
    names = [c.strip().split()[0] for c in DOCS.split(",")] + list(curate_texts.ADDED)
    cfg = CurateConfig(languages=("en", "DE", "fr"), least_chars=40)
    runs = [sorted(str(tuple(r)) for r in curate_texts.run(spark, source, out, cfg).select(*names).collect()) for _ in range(2)]
    con = duckdb.connect()
    want = sorted(map(str, con.execute(f"SELECT {', '.join(names)} FROM ({queries.CURATE_SQL.replace('documents', f'read_parquet({source + '/*.parquet'!r})')})").fetchall()))
    assert runs[0] == want and runs[1] == want
    assert set(os.listdir(f"{out}/archive/decision=dropped")) >= {"language=unknown", "language=es", "language=en"}


def test_curate_keeps_one_of_each(spark):
    docs = spark.createDataFrame(ODD, DOCS).selectExpr("*", "'mine' AS digest", "1 AS more")
    rows = curate_texts.decide(docs, CurateConfig()).collect()
    kept = [(r.doc_id, r.lang, r.source) for r in rows if r.decision == "kept"]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, "en", "a"), (7, " EN ", "a"), (8, "es", "b"), (10, None, None), (11, "de", "b")]))
    assert all(r.keep_id == 1 and r.group_size == 4 for r in rows if r.text and r.text.split() == ["one", "two", "three"])
    assert all(r.digest != "mine" and r.more == 1 for r in rows)
    assert curate_texts.decide(docs.limit(0), CurateConfig()).count() == 0


def test_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"languages": ["en"], "least_chars": 3}')
    assert load(spark, str(tmp_path / "a.json"), CurateConfig) == CurateConfig(languages=("en",), least_chars=3)
    (tmp_path / "b.json").write_text('{"language": ["en"]}')
    with pytest.raises(ValueError, match="language"):
        load(spark, str(tmp_path / "b.json"), CurateConfig)
    assert load(spark, "jobs/ingest_samples.json", IngestConfig) == queries.EVENTS
    assert load(spark, "jobs/curate_texts.json", CurateConfig) == queries.TEXTS


def test_registered_queries_leave_settings_alone(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.sources.partitionOverwriteMode")}
    assert queries.job1_ingest_samples(spark, SMALL).count() > 0 and queries.job2_curate_texts(spark, SMALL).count() > 0
    assert before == {k: spark.conf.get(k) for k in before}
    assert not spark.streams.active


@pytest.mark.parametrize("job", ["ingest_samples", "curate_texts"])
def test_command_line(spark, tmp_path, job):
    source = {"ingest_samples": f"{SMALL}/events.parque[t]", "curate_texts": f"{SMALL}/documents.parquet"}[job]
    more = ["--checkpoint", str(tmp_path / "mark")] if job == "ingest_samples" else []
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--source", source, "--output", str(tmp_path / "out"), "--config", f"jobs/{job}.json", *more], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read " in done.stderr
    assert len(os.listdir(tmp_path / "out")) >= 1


def shuffled_mb(spark):
    """MB that all stages of the session wrote to shuffles so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())) / 1e6


def test_curate_moves_texts_once(spark, tmp_path):
    rng = random.Random(4)
    docs = [(k, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000)), "en", "s", 3000) for k in range(1000)]
    source = str(tmp_path / "in")
    spark.createDataFrame(docs + docs[:50], DOCS).repartition(4).write.parquet(source)
    text_mb = 3 * 3000 * 1050 / 1e6
    before = shuffled_mb(spark)
    assert curate_texts.run(spark, source, str(tmp_path / "out"), CurateConfig()).count() == 1000
    moved = shuffled_mb(spark) - before
    print("MB moved", moved, "of texts", text_mb)
    assert moved < 1.5 * text_mb
