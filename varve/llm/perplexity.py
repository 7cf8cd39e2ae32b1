"""Quality rules: base counts of a text, and the perplexity of a character model of its language.

The model is an interpolated modified Kneser-Ney model of ``ORDER`` characters for each value of ``lang``
(null is a value of its own), estimated from all rows. A text is read by code points, white-space runs as one
space and digits as 0, with ``ORDER - 1`` start signs before it. Each task counts the longest grams of its
rows, and in how many rows each occurs; Spark sums these and derives all else by groupings and joins:
continuation counts of shorter grams, discounts from counts of counts by language and order, and what a
context leaves to the shorter gram.

A row's own spelling is no evidence for it: grams that fewer than ``min_docs`` rows hold are left out of the
model (their mass goes to the context's backoff), and a shorter gram stays where it ends one that stays.
The model is stored as one sorted array of 64-bit hashes of (language, kind, gram) with log values beside
it, and broadcast. Where more than ``max_grams`` longest grams stay, it would be too large for that: then Spark
joins the model to each different longest gram of the texts, which gives the gram's log probability, and the
rows are read once for each block of at most ``ENTRIES`` * ``max_grams`` of these values, of which one block at a time
is broadcast. Their sums are those of the whole model, at any size. (Five orders with a probability and a backoff
each make ten entries of 12 bytes at most for a longest gram.) ``train_perplexity`` gives a model in one piece to
score other texts by; it has to fit, so there, and there alone, ``min_docs`` is raised to the least number with
which at most ``max_grams`` stay.
Keys that share a hash would share a value; among 10^7 entries that is one chance in 10^5.

A text's log perplexity is its mean negative log probability by character. The bands of a language are the
median and ``width`` times the scaled median deviation of the rows that pass the base rules, both from an
exact histogram of log perplexities in thousandths; the deviation counts as ``least_deviation`` at least.
Too high is gibberish or another language, too low is one phrase over and over. A language with fewer than
``least_docs`` such rows has no bands and rejects none.

Edge cases: a null or empty text has no words, so the base rules fail it, and its log perplexity is null; a
text of white space alone likewise; repeated rows count as often as they occur, and get equal results; an
empty table gives an empty result; other columns are not read. Texts are hashed in pieces of bounded length.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, durable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ORDER = 5
START = 2  # the sign before a text; texts have U+FFFD in its place
PIECE = 1 << 20
MEMO = 1 << 19
TOGETHER = 1 << 16
ENTRIES = 2 * ORDER


@dataclass(frozen=True)
class PerplexityConfig:
    min_docs: int = 2
    max_grams: int = 1_000_000
    width: float = 8.0
    least_deviation: float = 0.02
    least_docs: int = 30
    min_words: int = 50
    max_repeat_percent: int = 50
    broadcast_langs: int = 100_000


# base counts


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = WORD.findall(text)
    lines, repeated = set(), 0
    for line in text.split("\n"):
        if line in lines:
            repeated += 1
        elif line.strip(SPACE):
            lines.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated, repeat_words(words)


def repeat_words(words: list[str]) -> int:
    """Words inside three-word windows that are found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 1 << 20:  # else three ids fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, window, n = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    often = n[window] >= 2
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(often)] |= often
    return int(hit.sum())


# characters and hashes


def characters(text: str) -> np.ndarray:
    """Code points with start signs before them; white-space runs are one space, digits are 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes = np.where(white, np.uint32(32), codes)[~(white & np.concatenate([[False], white[:-1]]))]
    codes[(codes > 48) & (codes < 58)] = 48
    codes[(codes == START) | (codes == 0)] = 0xFFFD
    return np.concatenate([np.full(ORDER - 1, START, np.uint32), codes])


def pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Overlapping pieces, so that each gram of full length lies in one of them."""
    for start in range(0, max(1, len(codes) - ORDER + 1), PIECE):
        yield codes[start : start + PIECE + ORDER - 1]


def rolled(codes: np.ndarray) -> list[np.ndarray]:
    """At n, the plain hashes of all grams of n characters by their first position."""
    wide = codes.astype(np.uint64)
    out = [np.zeros(len(codes) + 1, np.uint64)]
    for n in range(1, ORDER + 1):
        if len(codes) < n:
            out.append(np.zeros(0, np.uint64))
        else:
            out.append(out[-1][: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + (wide[n - 1 :] + np.uint64(1)))
    return out


@functools.lru_cache(10_000)
def seed_of(lang: str, kind: str, n: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{kind}{n}:{lang}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def mixed(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = (h ^ seed) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


# counting


class GramCounts:
    """Longest grams of one language: how often they occur, and in how many texts."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []  # keys, counts, texts, characters
        self.loose = 0

    def add(self, text: str) -> None:
        """Count one text; the grams of all its pieces are one text's."""
        found = []
        for codes in pieces(characters(text)):
            if len(codes) >= ORDER:
                keys, place, starts = runs(rolled(codes)[ORDER])
                n = np.diff(np.append(starts, len(place)))
                found.append((keys, n, np.ones(len(keys), np.int64), codes[place[starts][:, None] + np.arange(ORDER)]))
        if len(found) > 1:
            keys, n, _, chars = merged(found)
            found = [(keys, n, np.ones(len(keys), np.int64), chars)]
        self.parts += found
        self.loose += sum(len(f[0]) for f in found)
        if self.loose > PIECE:
            self.settle()

    def settle(self) -> None:
        if len(self.parts) > 1:
            self.parts = [merged(self.parts)]
        self.loose = 0

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, where the sorted ones come from, and where each begins among these."""
    place = np.argsort(keys)
    keys = keys[place]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], place, starts


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, n, docs, chars = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, place, starts = runs(keys)
    return keys, np.add.reduceat(n[place], starts), np.add.reduceat(docs[place], starts), chars[place[starts]]


def count_grams(rows: DataFrame, flush: int = 3_000_000) -> DataFrame:
    """(lang, gram, c, docs) of all longest grams of (lang, text)."""
    ddl = "lang string, gram string, c long, docs long"
    out = arrow_schema(rows.sparkSession, ddl)

    def told(counts: dict[str, GramCounts]) -> Iterator[pa.RecordBatch]:
        for lang, some in counts.items():
            some.settle()
            for _, n, docs, chars in some.parts:
                grams = np.ascontiguousarray(chars).view(f"<U{ORDER}").ravel()
                order = np.argsort(grams)
                for start in range(0, len(order), 100_000):
                    at = order[start : start + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(grams[at].tolist()), pa.array(n[at]), pa.array(docs[at])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, GramCounts] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch[1][row].as_py()
                if text:
                    counts.setdefault(batch[0][row].as_py(), GramCounts()).add(text)
            if sum(map(len, counts.values())) > flush:
                yield from told(counts)
                counts = {}
        yield from told(counts)

    counted = rows.select("lang", "text").mapInArrow(run, ddl)
    return counted.groupBy("lang", "gram").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


# the model


def discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from counts of counts; 1/2, 1 and 3/2 where these give none between 0 and the count."""
    counts = grams.groupBy("lang").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)])
    told = counts.selectExpr("lang", *[f"{k} - {k + 1} * (n1 / nullif(n1 + 2D * n2, 0)) * n{k + 1} / nullif(n{k}, 0) AS d{k}" for k in (1, 2, 3)])
    return told.selectExpr("lang", *[f"CASE WHEN d{k} > 0 AND d{k} < {k} THEN d{k} ELSE {k / 2}D END AS d{k}" for k in (1, 2, 3)])


def kneser_ney(grams: DataFrame, min_docs: int, small=lambda df: df) -> DataFrame:
    """(lang, kind, gram, value): p, the probability of a gram's last character; g, what a context leaves.

    ``grams`` has (lang, gram, c, docs) of the longest grams. Entries are natural logarithms. The gram of no
    characters has the probability of an unknown one.
    """
    levels = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        shorter = levels[n + 1].groupBy("lang", F.substring("gram", 2, ORDER).alias("gram"))
        levels[n] = durable(shorter.agg(F.count(F.lit(1)).alias("c"), F.max("docs").alias("docs")))
    lower = levels[1].groupBy("lang").agg(F.lit("").alias("gram"), (1.0 / (F.count(F.lit(1)) + 1)).alias("p"))
    told = lower.select("lang", F.lit("p").alias("kind"), "gram", F.log("p").alias("value"))
    for n in range(1, ORDER + 1):
        rows = levels[n].join(small(discounts(levels[n])), "lang").withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        left = F.expr("c - CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END")
        rows = rows.select("lang", "gram", "context", "c", F.when(F.col("docs") >= min_docs, left).alias("left"))
        sums = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("left").alias("used")).where("used is not null")
        sums = durable(sums.select("lang", "context", "total", F.greatest(F.lit(1e-12), 1 - F.col("used") / F.col("total")).alias("gamma")))
        suffix = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
        made = rows.where("left is not null").withColumn("suffix", F.substring("gram", 2, ORDER)).join(sums, ["lang", "context"]).join(suffix, ["lang", "suffix"])
        lower = durable(made.select("lang", "gram", (F.col("left") / F.col("total") + F.col("gamma") * F.col("p_lower")).alias("p")))
        told = told.unionByName(lower.select("lang", F.lit("p").alias("kind"), "gram", F.log("p").alias("value")))
        told = told.unionByName(sums.select("lang", F.lit("g").alias("kind"), F.col("context").alias("gram"), F.log("gamma").alias("value")))
    return told


def hashed(entries: DataFrame) -> DataFrame:
    """(key, value): entries by the hash of language, kind and gram."""
    ddl = "key long, value float"
    out = arrow_schema(entries.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for (lang, kind, n), some in rows.groupby(["lang", "kind", rows["gram"].str.len()], dropna=False):
                codes = np.frombuffer("".join(some["gram"]).encode("utf-32-le"), np.uint32).reshape(len(some), n)
                h = np.zeros(len(some), np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + (codes[:, k].astype(np.uint64) + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(mixed(h, seed_of(lang, kind, n)).view(np.int64)), pa.array(some["value"].to_numpy(np.float32))], schema=out)

    return entries.select("lang", "kind", "gram", "value").mapInArrow(run, ddl)


@dataclass
class PerplexityModel:
    """Sorted hashes with their log values; ``starts`` tells by leading bits where a hash would stand."""

    keys: np.ndarray
    values: np.ndarray
    bits: int = 0
    starts: np.ndarray | None = None
    memo: tuple[np.ndarray, np.ndarray] | None = None  # made in each worker

    def __post_init__(self) -> None:
        self.bits = max(8, int(len(self.keys)).bit_length())
        heads = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.starts = np.searchsorted(self.keys, heads).astype(np.int32)
        # an end that no search runs over: all ones, which is greater than any other hash
        self.keys = np.append(self.keys, np.uint64(2**64 - 1))
        self.values = np.append(self.values, np.float32(0))

    def find(self, h: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashed grams the model has, and their values (0 where it has not)."""
        want = mixed(h, seed)
        at = self.starts[want >> np.uint64(64 - self.bits)]
        behind = np.flatnonzero(self.keys[at] < want)
        while len(behind):  # hashes are even, so few share their leading bits
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < want[behind]]
        there = self.keys[at] == want
        return there, np.where(there, self.values[at], np.float32(0))

    def of_grams(self, h: list[np.ndarray], left: np.ndarray, lang: str) -> np.ndarray:
        """Log probabilities of the last characters of the longest grams at the positions ``left``."""
        out = np.zeros(len(left))
        row = np.arange(len(left))
        for n in range(ORDER, -1, -1):
            there, value = self.find(h[n][left + (ORDER - n)], seed_of(lang, "p", n))
            out[row] += value
            left, row = left[~there], row[~there]
            if not len(left) or n == 0:
                break
            out[row] += self.find(h[n - 1][left + (ORDER - n)], seed_of(lang, "g", n - 1))[1]
        return out

    def log_probabilities(self, codes: np.ndarray, lang: str) -> np.ndarray:
        """Of all characters but the first ORDER - 1, each given those before it.

        Grams come again and again, so each worker remembers the last one of each of MEMO slots.
        """
        h = rolled(codes)
        if self.memo is None:
            self.memo = np.zeros(MEMO, np.uint64), np.zeros(MEMO)
        known, told = self.memo
        key = mixed(h[ORDER], seed_of(lang, "memo", ORDER))
        slot = (key & np.uint64(MEMO - 1)).astype(np.int64)
        value = told[slot]
        new = np.flatnonzero(known[slot] != key)
        if len(new):
            value[new] = self.of_grams(h, new, lang)
            at = slot[new]
            known[at], told[at] = key[new], value[new]
        return value

    def log_perplexities(self, texts: list[str], lang: str) -> list[float | None]:
        """Of each text; short ones are looked up together."""
        out: list[float | None] = [None] * len(texts)
        queue: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            if queue:
                starts = np.cumsum([0] + [len(c) for _, c in queue])
                value = np.append(self.log_probabilities(np.concatenate([c for _, c in queue]), lang), 0.0)
                sums = np.add.reduceat(value, np.stack([starts[:-1], starts[1:] - ORDER + 1], 1).ravel())[::2]
                for (k, codes), total in zip(queue, sums.tolist(), strict=True):
                    out[k] = (out[k] or 0.0) - total / (len(whole[k]) - ORDER + 1)
                queue.clear()

        whole = [characters(t) for t in texts]
        size = 0
        for k, codes in enumerate(whole):
            if texts[k].strip(SPACE):
                for part in pieces(codes):
                    queue.append((k, part))
                    size += len(part)
                    if size > TOGETHER:
                        settle()
                        size = 0
        settle()
        return out

    def log_perplexity(self, text: str, lang: str) -> float | None:
        return self.log_perplexities([text], lang)[0]


@dataclass
class GramBlock(PerplexityModel):
    """A block of the longest grams with their log probabilities; those of other blocks count as 0."""

    def log_probabilities(self, codes: np.ndarray, lang: str) -> np.ndarray:
        return self.find(rolled(codes)[ORDER], seed_of(lang, "p", ORDER))[1].astype(np.float64)


def _sorted(entries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = entries.toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["value"].to_numpy()[order]


def _threshold(grams: DataFrame, cfg: PerplexityConfig) -> int:
    """The least number of rows, ``min_docs`` or more, that at most ``max_grams`` of the grams occur in."""
    kept = 0
    # one row for each number of rows that some gram occurs in, up to a million
    for r in grams.groupBy(F.least("docs", F.lit(1 << 20)).alias("docs")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("docs")).toLocalIterator():
        if r["docs"] < cfg.min_docs:
            break
        kept += r["k"]
        if kept > cfg.max_grams:
            return max(cfg.min_docs, r["docs"] + 1)
    return cfg.min_docs


def _entries(grams: DataFrame, min_docs: int, cfg: PerplexityConfig) -> DataFrame:
    few = grams.agg(F.count_distinct("lang")).first()[0] <= cfg.broadcast_langs
    return kneser_ney(grams, min_docs, F.broadcast if few else (lambda df: df))


def gram_values(grams: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, gram, value): the log probability of the last character of each of ``grams`` by ``entries`` of the model."""
    entries = durable(entries.withColumns({"n": F.length("gram"), "value": F.col("value").cast("float").cast("double")}))
    part = lambda kind, n, name, value: entries.where((F.col("kind") == kind) & (F.col("n") == n)).select("lang", F.col("gram").alias(name), F.col("value").alias(value))
    levels = {ORDER: grams.select("lang", "gram")}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = durable(levels[n + 1].select("lang", F.substring("gram", 2, ORDER).alias("gram")).distinct())
    told = part("p", 0, "gram", "value")
    for n in range(1, ORDER + 1):
        rows = levels[n].withColumns({"context": F.substring("gram", 1, n - 1), "suffix": F.substring("gram", 2, ORDER)})
        rows = rows.join(told.select("lang", F.col("gram").alias("suffix"), F.col("value").alias("lower")), ["lang", "suffix"])
        rows = rows.join(part("g", n - 1, "context", "g"), ["lang", "context"], "left").join(part("p", n, "gram", "p"), ["lang", "gram"], "left")
        told = durable(rows.select("lang", "gram", F.coalesce("p", F.coalesce("g", F.lit(0.0)) + F.col("lower")).alias("value")))
    return told


def train_perplexity(rows: DataFrame, cfg: PerplexityConfig = PerplexityConfig()) -> PerplexityModel:
    """Count all texts of (lang, text) and lay out a model in one piece; lang is never null."""
    grams = durable(count_grams(rows))
    return PerplexityModel(*_sorted(hashed(_entries(grams, _threshold(grams, cfg), cfg))))


# rules


def measured(docs: DataFrame, held: Broadcast, cfg: PerplexityConfig, carried: tuple[str, ...] = ()) -> DataFrame:
    """Base counts and log perplexity of every row by the model that is held, with the columns of longs that are carried along."""
    ddl = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double" + "".join(f", {c} long" for c in carried)
    out = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, langs, texts, *more = (batch.column(c).slice(start, 256).to_pylist() for c in ("doc_id", "lang", "text", *carried))
                logs: dict[int, float | None] = {}
                for lang in set(langs):
                    rows = [k for k, own in enumerate(langs) if own == lang]
                    logs.update(zip(rows, held.value.log_perplexities([texts[k] for k in rows], lang), strict=True))
                made = []
                for k, text in enumerate(texts):
                    counts = base_counts(text)
                    failed = counts[0] < cfg.min_words or 100 * counts[4] > cfg.max_repeat_percent * counts[0]
                    made.append((ids[k], langs[k], *counts, failed, logs[k], *(c[k] for c in more)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return docs.mapInArrow(run, ddl)


def _log_parts(docs: DataFrame, held: Broadcast) -> DataFrame:
    """(k1, k2, log_part): what the block of grams that is held adds to each row's log perplexity."""
    ddl = "k1 long, k2 long, log_part double"
    out = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                k1, k2, langs, texts = (batch.column(c).slice(start, 256).to_pylist() for c in ("k1", "k2", "lang", "text"))
                logs: list[float | None] = [None] * len(texts)
                for lang in set(langs):
                    rows = [k for k, own in enumerate(langs) if own == lang]
                    for k, value in zip(rows, held.value.log_perplexities([texts[k] for k in rows], lang), strict=True):
                        logs[k] = value
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((k1, k2, logs), out, strict=True)], schema=out)

    return docs.select("k1", "k2", "lang", "text").mapInArrow(run, ddl)


def measured_in_blocks(docs: DataFrame, values: DataFrame, cfg: PerplexityConfig) -> DataFrame:
    """As ``measured``, by hashed log probabilities of all longest grams, of which one block at a time is broadcast."""
    context = docs.sparkSession.sparkContext
    values = durable(values)
    blocks = max(1, -(-values.count() // (ENTRIES * cfg.max_grams)))
    # equal rows, which have equal parts, are one key
    of_row = [F.col("doc_id"), F.isnull("doc_id"), F.col("lang"), F.col("text")]
    keys = {"k1": F.xxhash64(*of_row), "k2": F.xxhash64(F.lit(1), *of_row)}
    rows, base, parts = docs.withColumns(keys), docs, []
    for block in range(blocks):
        held = context.broadcast(GramBlock(*_sorted(values.where(F.pmod("key", F.lit(blocks)) == block))))
        if block == 0:
            base = durable(measured(rows, held, cfg, tuple(keys)))
        else:
            parts.append(durable(_log_parts(rows, held)).withColumn("block", F.lit(block)))
        held.unpersist()
    if not parts:
        return base.drop(*keys)
    every = reduce(DataFrame.unionByName, parts).where("log_part IS NOT NULL").groupBy("k1", "k2", "block").agg(F.max("log_part").alias("log_part"))
    # added in the order of the blocks, so that a second run gives the same bits
    added = F.expr("aggregate(array_sort(collect_list(struct(block, log_part))), 0D, (sum, part) -> sum + part.log_part)")
    joined = base.join(every.groupBy("k1", "k2").agg(added.alias("others")), [*keys], "left")
    return durable(joined.withColumn("log_perplexity", F.col("log_perplexity") + F.coalesce("others", F.lit(0.0))).drop(*keys, "others"))


def perplexity_bands(rows: DataFrame, cfg: PerplexityConfig = PerplexityConfig()) -> DataFrame:
    """(lang, lower, upper) of the rows that pass the base rules, by exact histograms in thousandths."""
    bins = rows.where("NOT base_failed AND log_perplexity IS NOT NULL").groupBy("lang", F.round(F.col("log_perplexity") * 1000).cast("long").alias("x")).agg(F.count(F.lit(1)).alias("n"))

    def median(hist: DataFrame, name: str) -> DataFrame:
        """The least x that half of the rows do not exceed."""
        lang = Window.partitionBy("lang")
        through = hist.select("lang", "x", F.sum("n").over(lang.orderBy("x")).alias("through"), F.sum("n").over(lang).alias("all"))
        return through.where("2 * through >= all").groupBy("lang").agg(F.min("x").alias(name), F.max("all").alias("rows"))

    bins = durable(bins)
    middle = median(bins, "middle")
    away = bins.join(middle.select("lang", "middle"), "lang").groupBy("lang", F.abs(F.col("x") - F.col("middle")).alias("x")).agg(F.sum("n").alias("n"))
    bands = middle.join(median(away, "deviation").drop("rows"), "lang").where(F.col("rows") >= cfg.least_docs)
    reach = cfg.width * F.greatest(F.lit(cfg.least_deviation), 1.4826 * F.col("deviation") / 1000)
    return bands.select("lang", (F.col("middle") / 1000 - reach).alias("lower"), (F.col("middle") / 1000 + reach).alias("upper"))


def judge_quality(docs: DataFrame, cfg: PerplexityConfig = PerplexityConfig()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, log_perplexity, lower, upper of every row."""
    # a null language is apart from all names
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    grams = durable(count_grams(rows))
    entries = _entries(grams, cfg.min_docs, cfg)
    if _threshold(grams, cfg) == cfg.min_docs:
        model = PerplexityModel(*_sorted(hashed(entries)))
        scored = durable(measured(rows, docs.sparkSession.sparkContext.broadcast(model), cfg))
    else:
        scored = measured_in_blocks(rows, hashed(gram_values(grams, entries).withColumn("kind", F.lit("p"))), cfg)
    bands = durable(perplexity_bands(scored, cfg), 1)
    small = F.broadcast if bands.count() <= cfg.broadcast_langs else (lambda df: df)
    joined = scored.join(small(bands), "lang", "left")
    inside = F.expr("log_perplexity BETWEEN lower AND upper")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "log_perplexity", "lower", "upper")
