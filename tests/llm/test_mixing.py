"""Mixing against DuckDB, and its properties."""

import random

import duckdb
import pandas as pd
import pytest

from varve.llm.mixing import MixConfig, leaf_shares, mix_sources, mix_sql


def corpus(seed):
    rng = random.Random(seed)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice(["en", "de", "null", None]), rng.choice(["src1", "src11", "src12", "src2", "null", None]) if k % 3 else "src0") for k in range(700)]
    return rows + [(900, None, "en", "src1"), (5, "a b", "en", "src1"), (None, "x y z", "en", "src1"), (None, "x", "en", "src1")]


@pytest.mark.parametrize("cfg", [MixConfig(), MixConfig(budget_percent=30, max_epochs=1, rows_per_digit=20), MixConfig(budget_percent=900), MixConfig(weights={"domain": {"web": 0}, "lang": {}, "source": {"src11": 9}})])
def test_equals_sql(spark, make_docs, cfg):
    docs = make_docs(corpus(1))
    got = mix_sources(docs, cfg).select("doc_id", "domain", "lang", "source", "n_tokens", "copies").toPandas()
    con = duckdb.connect()
    frame = docs.drop("extra").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    want = con.execute(mix_sql(cfg)).df()
    rows = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None).astype({"doc_id": "Int64"}).itertuples(index=False, name=None)))
    assert rows(got) == rows(want[got.columns])


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100), ("web", "en", "b", 10), ("web", "de", "c", 1000), ("books", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    cfg = MixConfig(weights={"domain": {}, "lang": {}, "source": {}}, max_epochs=1, budget_percent=10)
    got = {r["source"]: r["share"] for r in leaf_shares(leaves, cfg).collect()}
    # 211 tokens: 106 and 105 a domain; web's 105 are 53 de and 52 en or so; b has but 10, a takes the rest
    assert sum(got.values()) == 211 and got["b"] == 10 and abs(got["a"] - 42) <= 1 and abs(got["c"] - 53) <= 1
    rich = MixConfig(weights={"domain": {}, "lang": {}, "source": {}}, max_epochs=1, budget_percent=100)
    assert {r["source"]: r["share"] for r in leaf_shares(leaves, rich).collect()} == {"a": 100, "b": 10, "c": 1000, "d": 1000}


def test_odd_tables(spark, make_docs):
    assert mix_sources(make_docs([])).count() == 0
    # no tokens: no budget, and the places before its end are all of them
    assert {(r.doc_id, r.n_tokens, r.copies) for r in mix_sources(make_docs([(1, None), (2, "")])).collect()} == {(1, 0, 1), (2, 0, 1)}
    same = mix_sources(make_docs([(None, "a b")] * 300 + [(None, "c")] * 300), MixConfig(rows_per_digit=4, budget_percent=100, max_epochs=1))
    assert same.count() == 600
    clash = make_docs(corpus(2)).withColumnRenamed("extra", "copies")
    out = mix_sources(clash)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "domain", "n_tokens", "copies"]
    assert isinstance(out.toPandas(), pd.DataFrame)
