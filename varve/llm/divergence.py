"""How far the sources of a language differ in their words: two-dimensional group-block tiling.

A group is a (lang, source). Terms are runs of letters: ASCII letters, of which A-Z is lower-cased, and
all characters beyond ASCII. A language keeps the terms that at least ``min_docs`` of its rows hold.
Each kept term has a smoothed share of a group, p = 1 + floor(scale * (count + 2) / (N + 2 * V)), and two
shares differ by f = floor((p - q)^2 / (p + q)). All of it is whole-number arithmetic.

Counting: each task sums the counts of its rows by group and term, and hands them on when they outgrow
``flush`` entries; one shuffle by (lang, term) gives counts, document counts and what is kept.

Pairs: a language's sources are cut into blocks of ``block``, its kept terms by hash into chunks of some
``chunk_terms``, and chunks into lanes of ``chunks_per_task``. A vector holds one group's shares in one
chunk, packed as two arrays of what occurs there. Each vector is replicated to the tasks (block, block,
lane) that need it. They are ordered by chunk, so a task lays out one chunk of two blocks at a time, adds
to its submatrix of pairs, and goes on; terms that neither block has are added in closed form. Lanes are
summed afterwards. No task holds more than two blocks of one chunk, however large the vocabulary is, and
a task's work has a bound too; the tiles are as many as the result, all pairs of a language's sources,
demands.

Edge cases: null text, lang and source are empty strings; a group without kept terms has p of count 0 for
every term; a language without kept terms gives pairs of value 0 and no terms; a lone source has no pairs;
ties go to the item that sorts first as UTF-8; rows that repeat a doc_id, or lack it, each count as a
document; an empty table gives an empty result; other columns are not read. A text is scanned as bytes,
term by term when it is long, so that its length costs no memory beyond its own distinct terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, durable

TERM = re.compile(rb"[a-z\x80-\xff]+")
LONG_TEXT = 4 << 20


@dataclass(frozen=True)
class DivergenceConfig:
    """``broadcast_bytes`` bounds what is broadcast: names and totals of groups; beyond it they are joined by a shuffle."""

    min_docs: int = 10
    top: int = 10
    scale: int = 1_000_000_000
    block: int = 32
    chunk_terms: int = 1024
    chunks_per_task: int = 64
    flush: int = 1_000_000
    broadcast_bytes: int = 8 << 20


def _named(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))


def terms_of(text: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text."""
    text = text.lower()  # of bytes: A-Z alone
    return Counter(TERM.findall(text)) if len(text) < LONG_TEXT else Counter(m.group() for m in TERM.finditer(text))


def partial_counts(docs: DataFrame, cfg: DivergenceConfig) -> DataFrame:
    """(lang, source, term, n, docs): sums within each task."""
    ddl = "lang string, source string, term string, n long, docs long"
    out = arrow_schema(docs.sparkSession, ddl)

    def told(counts: dict, holding: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), some in counts.items():
            terms = list(some)
            for start in range(0, len(terms), 50_000):
                part = terms[start : start + 50_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([some[t] for t in part], pa.int64()), pa.array([holding[lang, source][t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        holding: dict[tuple, Counter] = {}
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                group = (batch[0][row].as_py(), batch[1][row].as_py())
                found = terms_of(batch[2][row].as_py())
                some = counts.setdefault(group, Counter())
                size -= len(some)
                some.update(found)
                size += len(some)
                holding.setdefault(group, Counter()).update(found.keys())
                if size > cfg.flush:
                    yield from told(counts, holding)
                    counts, holding, size = {}, {}, 0
        yield from told(counts, holding)

    return docs.mapInArrow(run, ddl)


def _share(n: str, total: str, cfg: DivergenceConfig) -> Column:
    """p of a count among ``total``; 1 where nothing is kept."""
    above = f"CAST({cfg.scale} AS DECIMAL(10,0)) * (CAST({n} AS DECIMAL(20,0)) + 2)"
    return F.expr(f"CASE WHEN v > 0 THEN 1 + ({above}) div (CAST({total} AS DECIMAL(20,0)) + 2 * CAST(v AS DECIMAL(20,0))) ELSE 1L END")


def _tiles(vectors: DataFrame, cfg: DivergenceConfig) -> DataFrame:
    """(lang, a, b, f, seen, absent, v): each task's part of its submatrix, for sources a before b.

    ``vectors`` holds, by (lang, bi, bj, lane), first the rows of groups (chunk -1) and then the packed
    vectors in the order of their chunks.
    """
    ddl = "lang string, a string, b string, f long, seen long, absent long, v long"
    out = arrow_schema(vectors.sparkSession, ddl)
    block = cfg.block

    class Tile:
        def __init__(self, key: tuple) -> None:
            self.key, self.names, self.absent, self.v = key, {}, np.ones(2 * block, np.int64), 0
            self.sums, self.seen, self.chunk, self.rows, self.size = np.zeros((block, block), np.int64), 0, -1, [], 0

        def place(self, k: int) -> int:
            """Rows of the first block come first; a tile on the diagonal has one block only."""
            return k - self.key[1] * block if k // block == self.key[1] else block + k - self.key[2] * block

        def close_chunk(self) -> None:
            if not self.rows:
                return
            both = np.repeat(self.absent[:, None], self.size, axis=1)
            for k, at, p in self.rows:
                both[self.place(k), at] = p
            alone = self.key[1] == self.key[2]
            left, right = both[:block], both[:block] if alone else both[block:]
            for i in range(block):
                start = i + 1 if alone else 0
                d = right[start:] - left[i]
                self.sums[i, start:] += (d * d // (right[start:] + left[i])).sum(axis=1)
            self.seen += self.size
            self.rows = []

        def result(self) -> pa.RecordBatch:
            self.close_chunk()
            lang, bi, bj = self.key[:3]
            pairs = [(i, j) for i in self.names if i // block == bi for j in self.names if j // block == bj and i < j]
            rows = []
            for i, j in pairs:
                p, q = int(self.absent[self.place(i)]), int(self.absent[self.place(j)])
                rows.append({"lang": lang, "a": self.names[i], "b": self.names[j], "f": int(self.sums[i % block, j % block]), "seen": self.seen, "absent": (p - q) * (p - q) // (p + q), "v": self.v})
            return pa.RecordBatch.from_pylist(rows, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("lang", "bi", "bj", "lane")], strict=True))
            chunk, k, size, name, p0, v = (batch.column(c).to_pylist() for c in ("chunk", "k", "size", "name", "p0", "v"))
            at, p = batch.column("at"), batch.column("p")
            for row, key in enumerate(keys):
                if tile is None or tile.key != key:
                    if tile is not None:
                        yield tile.result()
                    tile = Tile(key)
                if chunk[row] < 0:
                    tile.names[k[row]], tile.absent[tile.place(k[row])], tile.v = name[row], p0[row], v[row]
                    continue
                if chunk[row] != tile.chunk:
                    tile.close_chunk()
                    tile.chunk, tile.size = chunk[row], size[row]
                tile.rows.append((k[row], at[row].values.to_numpy(), p[row].values.to_numpy()))
        if tile is not None:
            yield tile.result()

    return vectors.mapInArrow(run, ddl)


def audit_divergence(docs: DataFrame, cfg: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language, and the group's own terms."""
    spark = docs.sparkSession
    named = _named(docs)
    term = Window.partitionBy("lang", "term")
    counted = partial_counts(named, cfg).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = counted.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), (F.row_number().over(term.orderBy("source")) == 1).cast("long").alias("first"))
    kept = durable(counted.where(F.col("docs") >= cfg.min_docs).drop("docs"))

    lang = Window.partitionBy("lang")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum("first").alias("first"))
    groups = named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n_group", "first"])
    groups = groups.select("lang", "source", "n_group", F.sum("n_group").over(lang).alias("n_lang"), F.sum("first").over(lang).alias("v"), (F.row_number().over(lang.orderBy("source")) - 1).alias("k"), F.count(F.lit(1)).over(lang).alias("sources"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / cfg.chunk_terms)).cast("long")
    groups = durable(groups.withColumn("chunks", chunks).withColumn("blocks", F.expr(f"CAST((sources - 1) div {cfg.block} + 1 AS INT)")), 1)
    weight = groups.agg(F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source") + 100), F.lit(0))).first()[0]
    known = F.broadcast(groups) if weight <= cfg.broadcast_bytes else groups
    shares = kept.join(known, ["lang", "source"]).withColumn("p", _share("n", "n_group", cfg))

    own = shares.withColumn("q", _share("lang_n", "n_lang", cfg)).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    own = own.withColumn("rank", rank).where(F.col("rank") <= cfg.top)

    placed = shares.withColumn("chunk", F.expr("pmod(xxhash64(term), chunks)"))
    in_chunk = Window.partitionBy("lang", "chunk")
    placed = placed.withColumn("at", (F.dense_rank().over(in_chunk.orderBy("term")) - 1).cast("int"))
    placed = placed.withColumn("size", (F.max("at").over(in_chunk) + 1).cast("int"))
    packed = placed.groupBy("lang", "chunk", "source", "k", "blocks").agg(F.max("size").alias("size"), F.collect_list(F.struct("at", F.col("p").cast("int").alias("p"))).alias("s"))
    lane = F.expr(f"CAST(chunk div {cfg.chunks_per_task} AS INT)")
    packed = packed.select("lang", "k", "blocks", lane.alias("lane"), "chunk", "size", F.col("s.at").alias("at"), F.col("s.p").alias("p"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("v"))
    heads = groups.select("lang", "k", "blocks", F.explode(F.expr(f"sequence(0, CAST((chunks - 1) div {cfg.chunks_per_task} AS INT))")).alias("lane"), F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("size"), F.expr("CAST(NULL AS ARRAY<INT>)").alias("at"), F.expr("CAST(NULL AS ARRAY<INT>)").alias("p"), F.col("source").alias("name"), _share("0", "n_group", cfg).alias("p0"), "v")
    both = packed.unionByName(heads).withColumn("own", F.expr(f"CAST(k div {cfg.block} AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    both = both.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("own", "other", "blocks")
    tile = ["lang", "bi", "bj", "lane"]
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *tile).sortWithinPartitions(*tile, "chunk", "k")
    pairs = _tiles(both, cfg).groupBy("lang", "a", "b").agg((F.sum("f") + (F.max("v") - F.sum("seen")) * F.max("absent")).alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("d"), "value")
    pairs = pairs.select("lang", "d.source", F.lit("pair").alias("part"), "d.item", "value").withColumn("rank", rank)
    return pairs.unionByName(own).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def divergence_sql(cfg: DivergenceConfig = DivergenceConfig()) -> str:
    """DuckDB SQL of the same rows, by joining every group with every kept term of its language."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = lambda n, total: f"1 + ({cfg.scale}::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
keep AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {cfg.min_docs}),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(lang_n) AS n_lang FROM keep GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN keep USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n_group FROM g),
x AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "n_group")} AS p, {p("lang_n", "n_lang")} AS q FROM s JOIN v USING (lang) JOIN keep USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM x WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM o WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= {cfg.top}"""
