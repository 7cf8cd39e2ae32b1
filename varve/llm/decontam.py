"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` words (a shorter item is one window). A window is
a set of word shingles with their places. Shingles are ordered by how often documents have them, the
rarest first. A document contains a window only if it has all of its shingles, so the prefix that must
be joined is the single rarest one: each window is indexed under that shingle. A document's shingle that
meets the index gives a candidate; the length bound and the positional bound say whether the window fits
around it; the words are then compared exactly.

The benchmark is the stated query set: it is taken in blocks of bounded size (``block_words``; an item of
more words is cut into pieces that share all but the last word of a window), each block is broadcast, and
every block meets all documents. A block of 100,000 words takes some 80 MB in the driver and in each worker. Both passes - counting shingles and matching - read
whole texts, stream through Python, and shuffle only counts, and hits when there are several blocks.

Edge cases: a null or empty text has no words, is not hit and not contaminated; items without words have
no windows; items that repeat a text are each counted; repeated documents are each judged; an item_id is
compared as text, nulls among them as the empty text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow

#: Words: digits, A-Z, a-z and all beyond ASCII; matched on bytes, where every byte beyond 0x7F belongs to a word.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


@dataclass(frozen=True)
class DecontaminationConfig:
    window: int = 13
    shingle: int = 3
    block_words: int = 100_000
    share: int = 20  # contaminated if share * n_hit >= n_words


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def _blocks(benchmark: DataFrame, cfg: DecontaminationConfig) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(item_id as text, words) in blocks of bounded size; the items stream through the driver."""
    block, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").toLocalIterator():
        words = words_of(r["text"])
        if not words:
            continue
        # a piece has the windows that start in it
        for start in range(0, max(1, len(words) - cfg.window + 1), cfg.block_words):
            piece = words[start : start + cfg.block_words + cfg.window - 1]
            block.append((r["item"], piece))
            size += len(piece)
            if size >= cfg.block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def _shingles(window: tuple[bytes, ...], k: int) -> list[tuple[bytes, ...]]:
    k = min(k, len(window))
    return [window[i : i + k] for i in range(len(window) - k + 1)]


def shingle_counts(docs: DataFrame, wanted: set[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """How often the documents have each of the wanted shingles; a sum over all documents."""
    place = {s: k for k, s in enumerate(sorted(wanted))}
    by_first: dict[bytes, set[int]] = {}
    for s in wanted:
        by_first.setdefault(s[0], set()).add(len(s))

    def make():
        def work(rows: list[dict]) -> list[dict]:
            n: Counter[int] = Counter()
            for r in rows:
                words = words_of(r["text"])
                for i, w in enumerate(words):
                    if w in by_first:
                        for k in by_first[w]:
                            at = place.get(tuple(words[i : i + k]))
                            if at is not None:
                                n[at] += 1
            return [{"at": k, "n": c} for k, c in n.items()]

        return work

    got = map_arrow(docs.select("text"), make, "at int, n long", rows=4096).groupBy("at").agg(F.sum("n").alias("n")).collect()
    names = sorted(wanted)
    return {names[r["at"]]: r["n"] for r in got}


def build_index(block: list[tuple[str, list[bytes]]], counts: dict[tuple[bytes, ...], int], cfg: DecontaminationConfig):
    """first word -> lengths, and rarest shingle -> (offset, window); window -> items."""
    items: dict[tuple[bytes, ...], set[str]] = {}
    for item, words in block:
        for w in windows_of(words, cfg.window):
            items.setdefault(w, set()).add(item)
    index: dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...]]]] = {}
    for w in items:
        order = sorted((counts.get(s, 0), s, k) for k, s in enumerate(_shingles(w, cfg.shingle)))
        n, s, k = order[0]
        if n:  # a shingle that no document has: the window is in none
            index.setdefault(s, []).append((k, w))
    first: dict[bytes, tuple[int, ...]] = {}
    for s in index:
        first[s[0]] = tuple(sorted({len(s), *first.get(s[0], ())}))
    return first, index, items


def hit_ranges(words: list[bytes], first, index, items) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word ranges inside occurrences of windows, and the items that occur."""
    found: list[tuple[int, int]] = []
    hit: set[str] = set()
    n = len(words)
    for i, w in enumerate(words):
        if w in first:
            for k in first[w]:
                for offset, window in index.get(tuple(words[i : i + k]), ()):
                    start = i - offset
                    if start >= 0 and start + len(window) <= n and tuple(words[start : start + len(window)]) == window:
                        found.append((start, start + len(window)))
                        hit |= items[window]
    found.sort()
    merged: list[tuple[int, int]] = []
    for s, e in found:
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged, hit


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _row(doc_id, n: int, ranges: list[tuple[int, int]], items: set[str], share: int) -> dict:
    hit = sum(e - s for s, e in ranges)
    return {"doc_id": doc_id, "n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), "contaminated": hit > 0 and share * hit >= n}


def _indexes(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig):
    for block in _blocks(benchmark, cfg):
        wanted = {s for _, words in block for w in windows_of(words, cfg.window) for s in _shingles(w, cfg.shingle)}
        yield build_index(block, shingle_counts(docs, wanted), cfg)


def find_contamination(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """One row per document. One block needs no shuffle; the hits of several are merged by document."""
    indexes = _indexes(docs, benchmark, cfg)
    parts = next(indexes, ({}, {}, {}))
    more = next(indexes, None)
    if more is not None:
        return _merged(docs, chain((parts, more), indexes), cfg).drop("key")
    known = docs.sparkSession.sparkContext.broadcast(parts)

    def make():
        first, index, items = known.value

        def work(rows: list[dict]) -> list[dict]:
            out = []
            for r in rows:
                words = words_of(r["text"])
                out.append(_row(r["doc_id"], len(words), *hit_ranges(words, first, index, items), cfg.share))
            return out

        return work

    return map_arrow(docs.select("doc_id", "text"), make, RESULT)


def _merged(docs: DataFrame, indexes, cfg: DecontaminationConfig) -> DataFrame:
    """The way for benchmarks of more than one block: a pass for each block, then a merge of the few hits by document. ``key``, a hash of doc_id and text, names the row."""
    sc = docs.sparkSession.sparkContext
    keyed = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    hits = None
    for parts in indexes:
        known = sc.broadcast(parts)

        def make(known=known):
            first, index, items = known.value

            def work(rows: list[dict]) -> list[dict]:
                out = []
                for r in rows:
                    ranges, hit = hit_ranges(words_of(r["text"]), first, index, items)
                    if ranges:
                        out.append({"doc_id": r["doc_id"], "key": r["key"], "ranges": [x for s in ranges for x in s], "items": sorted(hit)})
                return out

            return work

        some = map_arrow(keyed, make, "doc_id long, key long, ranges array<long>, items array<string>")
        hits = some if hits is None else hits.unionByName(some)

    def counting():
        return lambda rows: [{"doc_id": r["doc_id"], "key": r["key"], "n_words": len(words_of(r["text"]))} for r in rows]

    sizes = map_arrow(keyed, counting, "doc_id long, key long, n_words long")
    grouped = hits.groupBy("doc_id", "key").agg(F.collect_set("ranges").alias("ranges"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    schema = f"{RESULT}, key long"
    out_schema = arrow_schema(docs.sparkSession, schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                spans = sorted((x[i], x[i + 1]) for x in r["ranges"] or () for i in range(0, len(x), 2))
                merged: list[tuple[int, int]] = []
                for s, e in spans:
                    if merged and s <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                    else:
                        merged.append((s, e))
                made.append(_row(r["doc_id"], r["n_words"], merged, set(r["items"] or ()), cfg.share) | {"key": r["key"]})
            yield pa.RecordBatch.from_pylist(made, schema=out_schema)

    same = sizes["doc_id"].eqNullSafe(grouped["doc_id"]) & (sizes["key"] == grouped["key"])
    joined = sizes.join(grouped, same, "left").select(sizes["doc_id"], sizes["key"], "n_words", "ranges", "items")
    return joined.mapInArrow(finish, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    With one block of items no row moves; with several the judgements are joined to the documents.
    """
    indexes = _indexes(docs, benchmark, cfg)
    parts = next(indexes, ({}, {}, {}))
    more = next(indexes, None)
    if more is not None:
        bad = _merged(docs, chain((parts, more), indexes), cfg).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
        return docs.join(bad.distinct(), docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64("doc_id", "text") == F.col("__key")), "left_anti")
    known = docs.sparkSession.sparkContext.broadcast(parts)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, 256):
                for text in batch.column(at).slice(start, 256).to_pylist():
                    words = words_of(text)
                    keep.append(not _row(None, len(words), *hit_ranges(words, *known.value), cfg.share)["contaminated"])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
