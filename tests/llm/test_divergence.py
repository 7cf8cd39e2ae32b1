"""The audit against DuckDB, with tiles, chunks and lanes small enough that there are many of each."""

import random

import duckdb
import pytest

from varve.llm.divergence import DivergenceConfig, audit_divergence, divergence_sql, terms_of

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def corpus(seed, rows=400):
    rng = random.Random(seed)
    words = ["w" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(120)] + ["Ünder", "éTÉ", "中文", "MIXed", "mixed", "a1b", "x_y"]
    out = []
    for k in range(rows):
        source = "hot" if k % 3 == 0 else f"s{rng.randrange(7)}"
        shift = len(source) + ord(source[-1])
        some = [words[min(len(words) - 1, int(rng.expovariate(1 / 25)) + shift % 5)] for _ in range(rng.randrange(0, 30))]
        out.append((k, " ".join(some), rng.choice(["en", "de", None, ""]), source))
    return out + [(7, None, "en", "s1"), (None, "wab " * 50, "en", None), (None, "", "en", "bare"), (8, "one two", "xx", "alone"), (9, "three", "yy", "p"), (9, None, "yy", "q"), (10, "wab,WAB" * 3000, "de", "hot")]


def rows_of(frame):
    return sorted(tuple(map(str, r)) for r in frame[COLUMNS].itertuples(index=False, name=None))


def wanted(docs, cfg):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    return rows_of(con.execute(divergence_sql(cfg)).df())


@pytest.mark.parametrize("cfg", [DivergenceConfig(), DivergenceConfig(block=3, chunk_terms=8, chunks_per_task=2, flush=50, top=4), DivergenceConfig(block=2, chunk_terms=30, chunks_per_task=1, min_docs=1, broadcast_bytes=0)])
def test_equals_sql(spark, make_docs, cfg):
    docs = make_docs(corpus(3))
    got = rows_of(audit_divergence(docs, cfg).toPandas())
    assert got == wanted(docs, cfg)
    assert {("yy", "p", "pair", "q")} <= {r[:4] for r in got}


def test_large_counts_are_exact(spark, make_docs):
    docs = make_docs([(k, "aa " * (1000 + 7 * k) + "bb " * (k % 5), "en", f"s{k % 4}") for k in range(40)])
    assert rows_of(audit_divergence(docs).toPandas()) == wanted(docs, DivergenceConfig())


def test_odd_tables(spark, make_docs):
    assert audit_divergence(make_docs([])).count() == 0
    assert audit_divergence(make_docs([(1, "a b", "en", "s")])).count() == 0
    clash = make_docs(corpus(5)).withColumnRenamed("extra", "term").withColumnRenamed("n_chars", "rank")
    assert audit_divergence(clash).columns == COLUMNS
    assert audit_divergence(make_docs([(k, None, None, None) for k in range(20)])).count() == 0


def test_terms():
    assert terms_of("A1bC-ÀÉ é_É".encode()) == {b"a": 1, b"bc": 1, "ÀÉ".encode(): 1, "é".encode(): 1, "É".encode(): 1}
    long = b"ab cd " * 900_000
    assert terms_of(long) == {b"ab": 900_000, b"cd": 900_000}
