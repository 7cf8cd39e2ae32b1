"""Mixing sources to target weights, with DataFrame functions only.

The tree is domain - language - source; each document belongs to one leaf. A node's supply is the sum
of its leaves' tokens times the epochs allowed. The budget is propagated from the root: at each node it
is shared among the children by weight; a child that cannot fill its share gives the shortage to its
siblings, by weight, and only what all siblings cannot take is missing at the ancestor, which shares it
among its own siblings in the same way. (A node is never asked for more than its supply, so shares are
computed downwards in closed form: children in ascending order of supply by weight are full as long as
the common level of the rest is above them.) Shares are whole tokens; what rounding leaves goes to the
first unfilled children by name, one token each.

A leaf takes whole epochs while its share lasts, and of the last epoch the longest token prefix, in the
order of a seeded hash of that epoch. The prefix is found without sorting a leaf in one task: tokens are
summed by leaf and leading hash digits, the digits where the share ends are found from those sums, and
only the documents with these digits are ordered.

Edge cases: null domain, language or source is a node of its own, apart from one named ``null``; a null or empty text has no
tokens, fits any prefix and is taken if its place in the order lies before the end of the share; rows that
repeat a doc_id have one place in the order and are taken or left together; a budget beyond the supply
is cut to it; weights of 0 give nothing; an empty table gives an empty result. Other columns stay, and
may have any names but the three that are added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    """Weights are whole numbers by node name; a name that is not listed has ``other``. ``domain`` is an SQL expression over the table's columns, such as the name of a column that holds the domain."""

    domain: str = "CASE WHEN source IS NULL THEN NULL WHEN length(source) <= 4 THEN 'web' ELSE 'books' END"
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"web": 3, "books": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}})
    other: int = 1
    budget_percent: int = 150
    max_epochs: int = 4
    seed: int = 20260926
    rows_per_digit: int = 2000
    broadcast_leaves: int = 100_000


LEVELS = ("domain", "lang", "source")
NAMED = "="  # stands before the names of nodes; a null is the empty name


def _weight(level: str, cfg: MixConfig) -> Column:
    out = F.lit(cfg.other)
    for name, w in cfg.weights.get(level, {}).items():
        out = F.when(F.col(level) == NAMED + name, w).otherwise(out)
    return out.cast("decimal(38,0)")


def _shared(nodes: DataFrame, parents: list[str], level: str, cfg: MixConfig) -> DataFrame:
    """Deal each parent's ``budget`` to the nodes (parents, level, supply) below it; adds ``share``."""
    by = ", ".join(parents) or "1"
    rows = nodes.withColumn("w", _weight(level, cfg)).withColumn("supply", F.when(F.col("w") > 0, F.col("supply")).otherwise(F.lit(0)))
    order = f"PARTITION BY {by} ORDER BY CASE WHEN w > 0 THEN CAST(supply AS DOUBLE) / CAST(w AS DOUBLE) ELSE -1D END, {level}"
    rows = rows.selectExpr("*", f"CAST(coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(38,0)) AS below", f"CAST(sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DECIMAL(38,0)) AS rest")
    rows = rows.selectExpr("*", "supply * rest <= (budget - below) * w AS full")
    rows = rows.selectExpr("*", f"CAST(budget - coalesce(sum(CASE WHEN full THEN supply END) OVER (PARTITION BY {by}), 0) AS DECIMAL(38,0)) AS open_budget", f"CAST(sum(CASE WHEN NOT full THEN w END) OVER (PARTITION BY {by}) AS DECIMAL(38,0)) AS open_w")
    rows = rows.selectExpr("*", "CASE WHEN full THEN CAST(supply AS BIGINT) ELSE (open_budget * w) DIV open_w END AS base")
    rows = rows.selectExpr("*", f"CAST(open_budget - sum(CASE WHEN NOT full THEN base ELSE 0 END) OVER (PARTITION BY {by}) AS BIGINT) AS loose", f"row_number() OVER (PARTITION BY {by}, full ORDER BY {level}) AS place")
    return rows.selectExpr(*parents, level, "base + CASE WHEN NOT full AND place <= loose THEN 1 ELSE 0 END AS share")


def leaf_shares(leaves: DataFrame, cfg: MixConfig) -> DataFrame:
    """domain, lang, source, tokens, share of every leaf."""
    supply = leaves.withColumn("supply", (F.col("tokens") * cfg.max_epochs).cast("decimal(38,0)"))
    total = supply.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("s"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    budget = total.select(F.least(F.col("s"), F.floor(F.col("t") * cfg.budget_percent / 100)).cast("decimal(38,0)").alias("budget"))
    parents: list[str] = []
    dealt = None
    for level in LEVELS:
        keys = [*parents, level]
        nodes = supply.groupBy(*keys).agg(F.sum("supply").cast("decimal(38,0)").alias("supply"))
        # the budget is one row, the nodes above are fewer than these
        nodes = nodes.join(F.broadcast(budget)) if dealt is None else nodes.join(dealt.withColumnRenamed("share", "budget").withColumn("budget", F.col("budget").cast("decimal(38,0)")), parents)
        dealt = _shared(nodes, parents, level, cfg)
        parents = keys
    return leaves.join(dealt, list(LEVELS))


def _place(cfg: MixConfig, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(cfg.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _named(docs: DataFrame, cfg: MixConfig) -> DataFrame:
    """docs with the leaf's names, never null, in columns whose names no table has."""
    name = lambda c: F.coalesce(F.concat(F.lit(NAMED), c.cast("string")), F.lit(""))
    return docs.withColumns({"__domain": name(F.expr(cfg.domain)), "__lang": name(F.col("lang")), "__source": name(F.col("source"))})


def mix_sources(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, with domain, n_tokens and copies (how often it takes them)."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = durable(_named(docs, cfg).select("doc_id", *[F.col(f"__{c}").alias(c) for c in LEVELS], tokens.alias("n_tokens")))
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    shares = durable(leaf_shares(leaves, cfg).withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(0))).withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens")), 1)
    n, leaf_count = shares.agg(F.coalesce(F.max("docs"), F.lit(0)), F.count(F.lit(1))).first()
    # at most some 100 bytes a leaf: beyond this count the joins shuffle instead
    small = F.broadcast if leaf_count <= cfg.broadcast_leaves else (lambda df: df)
    digits = max(1, min(8, math.ceil(math.log(max(2, n / cfg.rows_per_digit), 16))))
    placed = slim.join(small(shares.select(*LEVELS, "epochs", "rest")), list(LEVELS)).withColumn("place", _place(cfg, F.col("epochs"))).withColumn("lead", F.substring("place", 1, digits))
    leaf = ", ".join(LEVELS)
    sums = placed.groupBy(*LEVELS, "rest", "lead").agg(F.sum("n_tokens").alias("n"))
    until = sums.selectExpr("*", f"sum(n) OVER (PARTITION BY {leaf} ORDER BY lead) AS through")
    edge = durable(until.where("through > rest").groupBy(*LEVELS).agg(F.min(F.struct("lead", (F.col("through") - F.col("n")).alias("before"))).alias("e")).select(*LEVELS, F.col("e.lead").alias("edge"), F.col("e.before").alias("before")), 1)
    # rows of one place, as of null or repeated doc_ids, are summed before they are ordered
    at_edge = placed.join(small(edge), list(LEVELS)).where("lead = edge").groupBy(*LEVELS, "edge", "before", "rest", "place").agg(F.sum("n_tokens").alias("n"))
    last = at_edge.selectExpr(*LEVELS, "place", "rest", f"before + sum(n) OVER (PARTITION BY {leaf}, edge ORDER BY place) AS through")
    cut = last.where("through <= rest").groupBy(*LEVELS).agg(F.max("place").alias("cut"))
    ends = shares.select(*LEVELS, "epochs").join(edge.select(*LEVELS, "edge"), list(LEVELS), "left").join(cut, list(LEVELS), "left")
    ends = ends.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], F.col("epochs").alias("__epochs"), F.col("edge").alias("__edge"), F.col("cut").alias("__cut"))
    # before the edge digits, or among them up to the cut; a leaf without an edge is taken whole once more
    place = _place(cfg, F.col("__epochs"))
    taken = F.when(F.col("__edge").isNull(), True).otherwise((F.substring(place, 1, digits) < F.col("__edge")) | F.coalesce(place <= F.col("__cut"), F.lit(False)))
    full = _named(docs, cfg).join(small(ends), [f"__{c}" for c in LEVELS])
    full = full.withColumn("__copies", (F.col("__epochs") + taken.cast("long")).cast("long")).where("__copies > 0")
    kept = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    return full.select(*kept, F.when(F.col("__domain") != "", F.substring("__domain", 1 + len(NAMED), 1 << 30)).alias("domain"), tokens.alias("n_tokens"), F.col("__copies").alias("copies"))


def mix_sql(cfg: MixConfig = MixConfig()) -> str:
    """DuckDB SQL for doc_id, domain, lang, source, n_tokens, copies of what ``mix_sources`` takes."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [
        f"d AS (SELECT doc_id, coalesce('{NAMED}' || ({cfg.domain}), '') AS domain, coalesce('{NAMED}' || lang, '') AS lang, coalesce('{NAMED}' || source, '') AS source, ({cfg.domain}) AS own_domain, lang AS own_lang, source AS own_source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens FROM documents)",
        f"leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) * {cfg.max_epochs} AS HUGEINT) AS supply FROM d GROUP BY ALL)",
        f"total AS (SELECT CAST(least(sum(supply), floor(sum(tokens) * {cfg.budget_percent} / 100)) AS HUGEINT) AS budget FROM leaf)",
    ]
    parents: list[str] = []
    for level in LEVELS:
        keys = [*parents, level]
        k, by = ", ".join(keys), "PARTITION BY " + ", ".join(parents) if parents else ""
        above = f"s_{parents[-1]}" if parents else "total"
        join = f"JOIN {above} USING ({', '.join(parents)})" if parents else "CROSS JOIN total"
        share = "share AS budget" if parents else "budget"
        w = "CASE " + " ".join(f"WHEN {level} = {quoted(NAMED + n)} THEN {v}" for n, v in cfg.weights.get(level, {}).items()) + f" ELSE {cfg.other} END" if cfg.weights.get(level) else str(cfg.other)
        order = f"{by} ORDER BY CASE WHEN w > 0 THEN CAST(supply AS DOUBLE) / CAST(w AS DOUBLE) ELSE -1 END, {level}"
        parts += [
            f"n_{level} AS (SELECT {k}, CASE WHEN w > 0 THEN supply ELSE 0 END AS supply, w, {share} FROM (SELECT {k}, CAST(sum(supply) AS HUGEINT) AS supply, CAST({w} AS HUGEINT) AS w FROM leaf GROUP BY {k}) {join})",
            f"a_{level} AS (SELECT *, supply * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= (budget - coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM n_{level})",
            f"b_{level} AS (SELECT *, CAST(budget - coalesce(sum(CASE WHEN is_full THEN supply END) OVER ({by}), 0) AS HUGEINT) AS ob, CAST(sum(CASE WHEN NOT is_full THEN w END) OVER ({by}) AS HUGEINT) AS ow FROM a_{level})",
            f"c_{level} AS (SELECT *, CASE WHEN is_full THEN supply ELSE (ob * w) // ow END AS base FROM b_{level})",
            f"s_{level} AS (SELECT {k}, CAST(base + CASE WHEN NOT is_full AND row_number() OVER ({by + ', is_full' if by else 'PARTITION BY is_full'} ORDER BY {level}) <= ob - sum(CASE WHEN NOT is_full THEN base ELSE 0 END) OVER ({by}) THEN 1 ELSE 0 END AS HUGEINT) AS share FROM c_{level})",
        ]
        parents = keys
    parts += [
        "e AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs, share - CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END * tokens AS rest FROM leaf JOIN s_source USING (domain, lang, source))",
        f"p AS (SELECT d.*, epochs, rest, md5(concat_ws(':', '{cfg.seed}', CAST(epochs AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS place FROM d JOIN e USING (domain, lang, source))",
        "q AS (SELECT *, CAST(epochs AS BIGINT) + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS copies FROM p)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, own_domain AS domain, own_lang AS lang, own_source AS source, n_tokens, CAST(copies AS BIGINT) AS copies FROM q WHERE copies > 0"
