"""URL filters by association rules.

Host and path rules judge the urls that they fit. The urls so judged are labels: FP-growth mines
combinations of url tokens that go with a verdict, the rules are pruned by support, confidence and
redundancy, and an inverted index (each mined rule under its rarest token) matches them to the urls
that no given rule fits. The best matching rule, by confidence, then support, then length, gives the
verdict; without a match a url is allowed.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed
unless a mined rule fits; an empty path starts with no rule's path; repeated urls get equal verdicts;
of rules that fit, the longest (host and path together) wins, then the one that sorts first. With no
label nothing is mined. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The given rules, (rule, verdict).
GIVEN_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


@dataclass(frozen=True)
class UrlRuleConfig:
    rules: tuple[tuple[str, str], ...] = GIVEN_RULES
    min_support: float = 0.005
    min_confidence: float = 0.8


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule = verdict = None
    for text, judged in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(judged)) if verdict is None else verdict.when(fits, F.lit(judged))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def url_tokens(url: str | None, host: str, path: str) -> list[str]:
    """Distinct tokens: scheme, host labels and endings, path segments by place (digits as one token), extension, query keys, fragment."""
    url = url or ""
    out = {"scheme=" + url.partition("://")[0].lower()} if "://" in url else set()
    labels = host.split(".")
    out.update("label=" + x for x in labels if x)
    out.update("ends=" + ".".join(labels[-k:]) for k in (1, 2, 3) if len(labels) >= k and host)
    for k, part in enumerate(x for x in path.split("/") if x):
        stem, dot, ext = part.rpartition(".")
        out.add(f"at{k}=" + re.sub("[0-9]+", "#", stem if dot else part))
        lead = re.match("[0-9]", part)
        if lead:
            out.add(f"lead{k}={lead[0]}")
        if dot:
            out.add("ext=" + ext.lower())
    tail = url.partition("#")
    out.update("key=" + p.partition("=")[0] for p in tail[0].partition("?")[2].split("&") if p)
    if tail[1]:
        out.add("fragment")
    return sorted(out)


def mine_rules(labelled: DataFrame, cfg: UrlRuleConfig) -> list[tuple[frozenset[str], str, float, float]]:
    """(tokens, verdict, confidence, support) mined from rows (tokens, verdict); a rule that a shorter one with no less confidence implies is dropped."""
    baskets = labelled.select(F.array_distinct(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.col("verdict"))))).alias("items"))
    if baskets.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=cfg.min_support, minConfidence=cfg.min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("verdict=") & ~F.exists("antecedent", lambda t: t.startswith("verdict=")))
    rest = durable(rules.select(F.sort_array("antecedent").alias("tokens"), F.element_at("consequent", 1).substr(len("verdict=") + 1, 1 << 30).alias("verdict"), "confidence", "support"))
    # level by level: what no shorter rule implies stays and prunes the longer ones, in tasks; only rules that stay come to the driver
    kept: list[tuple[frozenset[str], str, float, float]] = []
    while size := rest.agg(F.min(F.size("tokens"))).first()[0]:
        level = [(frozenset(r["tokens"]), r["verdict"], r["confidence"], r["support"]) for r in rest.where(F.size("tokens") == size).collect()]
        kept += sorted(level, key=lambda r: (-r[2], sorted(r[0]), r[1]))
        rest = durable(_not_implied(rest.where(F.size("tokens") > size), level))
    return kept


def _not_implied(rules: DataFrame, shorter: list[tuple[frozenset[str], str, float, float]]) -> DataFrame:
    """The rules without a shorter one among their tokens that has their verdict and no less confidence."""
    index = inverted_index(shorter)

    def make():
        def implied(r: dict) -> bool:
            own = set(r["tokens"])
            some = (shorter[k] for t in own for k in index.get(t, ()))
            return any(v == r["verdict"] and c >= r["confidence"] and tokens < own for tokens, v, c, _ in some)

        return lambda rows: [r for r in rows if not implied(r)]

    return map_arrow(rules, make, "tokens array<string>, verdict string, confidence double, support double", rows=4096)


def inverted_index(rules: list[tuple[frozenset[str], str, float, float]]) -> dict[str, list[int]]:
    """Each rule under the token that the fewest rules have; rules best first."""
    n: dict[str, int] = {}
    for tokens, *_ in rules:
        for t in tokens:
            n[t] = n.get(t, 0) + 1
    out: dict[str, list[int]] = {}
    for k, (tokens, *_) in enumerate(rules):
        out.setdefault(min(tokens, key=lambda t: (n[t], t)), []).append(k)
    return out


def judge_urls(pages: DataFrame, cfg: UrlRuleConfig = UrlRuleConfig()) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule that judged (else null), for every page."""
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), cfg.rules)
    rows = rows.withColumns({"rule": rule, "given": verdict})

    def tokenising():
        return lambda some: [{"tokens": url_tokens(r["url"], r["host"], r["path"]), "verdict": r["given"]} for r in some]

    labelled = map_arrow(rows.where("given is not null").select("url", "host", "path", "given"), tokenising, "tokens array<string>, verdict string", rows=4096)
    rules = sorted(mine_rules(labelled, cfg), key=lambda r: (-r[2], -r[3], -len(r[0]), sorted(r[0])))
    index = inverted_index(rules)

    def make():
        def work(some: list[dict]) -> list[dict]:
            out = []
            for r in some:
                mined = None
                if r["given"] is None:
                    own = set(url_tokens(r["url"], r["host"], r["path"]))
                    mined = min((k for t in own for k in index.get(t, ()) if rules[k][0] <= own), default=None)
                out.append({"page_id": r["page_id"], "host": r["host"], "path": r["path"], "rule": r["rule"], "verdict": r["given"] or ("allow" if mined is None else rules[mined][1]), "mined": None if mined is None else " ".join(sorted(rules[mined][0]))})
            return out

        return work

    return map_arrow(rows, make, "page_id long, host string, path string, rule string, verdict string, mined string", rows=4096)
