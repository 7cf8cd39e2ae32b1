"""N-gram Jaccard self-join by filters under multiple global token orders.

A document's set holds its distinct word shingles. Exact copies of a set are collapsed first; what
follows works on distinct sets.

1. Shingles are counted over all documents (map-side sums of 48-bit hashes, dealt by hash).
2. Order one puts shingles that few sets have first. Each set emits the prefix that a partner must share
   (n - ceil(0.8 n) + 1 shingles) with its places. Sets that meet under a shingle are candidates if the
   length bound and the positional bound allow the similarity. A shingle of at most ``small`` sets gives
   these pairs; one of more sets gives only a star around its most central set, the hub.
3. The further orders are keyed permutations of the hashes. Candidates must share a prefix shingle under
   each of them too: the sets' prefixes, a fifth of their shingles, are joined to the pairs, one order
   after the other, and only the pairs that pass all orders meet the sets themselves and are counted exactly.
4. Stars whose sets are not all linked by then are dealt into blocks of bounded size, those beside the
   star's largest component against all; each pair of blocks is compared in one task, under the same
   orders, skipping sets that are linked already. So no link is lost and no group's pairs are emitted.
5. Union-find by star contraction gives components.

A set is named by half of a 128-bit fingerprint; should two sets have one name, which the other half
tells, all are named anew with another salt.

Any global order is a right one: counts only make it a fast one. ``most_counted`` bounds the broadcast
table of frequent shingles (24 MB); shingles beyond it rank as rare, which costs time but no link.

Edge cases: a null or empty text, or one without words, has an empty set, is linked with nothing and is
its own component; a text of fewer words than the shingle has one element; repeated rows of one doc_id
are copies of each other; a row with a null doc_id takes part, and its component is the smallest doc_id
reached, null if there is none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, durable, map_arrow
from .components import components


@dataclass(frozen=True)
class JoinConfig:
    words: int = 5
    percent: int = 80  # linked if 100 * intersection >= percent * union
    small: int = 8
    orders: tuple[int, ...] = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    most_counted: int = 2_000_000
    chunk_tokens: int = 1_000_000
    bucket_tokens: int = 2_000_000
    block_tokens: int = 400_000
    salt: int = 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``k`` words; words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    k = min(k, len(h))
    n = len(h) - k + 1
    x = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        x = x * np.uint64(0x100000001B3) + _mix(h[i : i + n] + np.uint64(i))
    return np.unique(_mix(x))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _fingerprint(tokens: np.ndarray, salt: int) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def document_sets(docs: DataFrame, cfg: JoinConfig) -> DataFrame:
    """doc_id, key (a hash of the text), n (size of the set) and the set's fingerprint f1, f2 of every row."""

    def make():
        def work(rows: list[dict]) -> list[dict]:
            out = []
            for r in rows:
                t = shingle_set(r["text"], cfg.words)
                f1, f2 = _fingerprint(t, cfg.salt)
                out.append({"doc_id": r["doc_id"], "key": r["key"], "n": len(t), "f1": f1, "f2": f2})
            return out

        return work

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), make, "doc_id long, key long, n long, f1 long, f2 long")


def _sets_of(batches: Iterator[pa.RecordBatch], cfg: JoinConfig) -> Iterator[tuple[int, np.ndarray]]:
    """(fingerprint, set) of the texts, each distinct set once in a task."""
    seen: set[int] = set()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for text in batch.column(0).slice(start, 256).to_pylist():
                t = shingle_set(text, cfg.words)
                if len(t):
                    f1, _ = _fingerprint(t, cfg.salt)
                    if f1 not in seen:
                        seen.add(f1)
                        yield f1, t


def _dealt(buckets: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(n_buckets + 1))


def _bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return (_mix(key) % np.uint64(n_buckets)).astype(np.int64)


def _split48(key: np.ndarray) -> tuple[bytes, bytes]:
    return (key >> np.uint64(16)).astype(np.uint32).tobytes(), (key & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def _join48(hi: bytes, lo: bytes) -> np.ndarray:
    return (np.frombuffer(hi, dtype=np.uint32).astype(np.uint64) << np.uint64(16)) | np.frombuffer(lo, dtype=np.uint16)


def frequent_shingles(docs: DataFrame, n_buckets: int, cfg: JoinConfig) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 48-bit keys of the shingles that more than ``small`` sets have, and their counts."""
    schema = "bucket int, hi binary, lo binary, many binary"
    out = arrow_schema(docs.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            order, ends = _dealt(_bucket(key, n_buckets), n_buckets)
            rows = []
            for b in range(n_buckets):
                at = order[ends[b] : ends[b + 1]]
                if len(at):
                    hi, lo = _split48(key[at])
                    more = np.flatnonzero(n[at] > 1).astype(np.uint32)
                    rows.append({"bucket": b, "hi": hi, "lo": lo, "many": np.concatenate([more, n[at][more].astype(np.uint32)]).tobytes()})
            return pa.RecordBatch.from_pylist(rows, schema=out)

        parts, size = [], 0
        for _, t in _sets_of(batches, cfg):
            parts.append(t >> np.uint64(16))
            size += len(t)
            if size >= cfg.chunk_tokens:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)

    total_schema = "key long, n long"
    total_out = arrow_schema(docs.sparkSession, total_schema)

    def total(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for r in table.select(["hi", "lo", "many"]).to_pylist():
            key = _join48(r["hi"], r["lo"])
            n = np.ones(len(key), dtype=np.int64)
            at, c = np.frombuffer(r["many"], dtype=np.uint32).reshape(2, -1)
            n[at] = c
            keys.append(key)
            counts.append(n)
        key, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.add.reduceat(n, starts)
        keep = n > cfg.small
        return pa.table({"key": key[starts][keep].astype(np.int64), "n": n[keep]}, schema=total_out)

    counted = durable(docs.select("text").mapInArrow(count, schema).groupBy("bucket").applyInArrow(total, total_schema))
    # the table that is broadcast is bounded: classes of counts, the highest first, are taken while they fit
    size_class = F.floor(F.log2("n") * 16)
    classes = counted.groupBy(size_class.alias("k")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("k")).collect()
    room, least = cfg.most_counted, None
    for r in classes:
        room -= r["c"]
        if room < 0:
            break
        least = r["k"]
    got = counted.where(size_class >= F.lit(least) if least is not None else F.lit(False)).toArrow()
    key, n = got["key"].to_numpy().astype(np.uint64), got["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def ranked_prefix(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], p: int) -> np.ndarray:
    """The first ``p`` tokens under order one: by count, then by hash."""
    keys, counts = frequent
    if not len(keys):
        return tokens[:p]
    own = tokens >> np.uint64(16)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    n = np.where(keys[at] == own, counts[at], 0)
    return tokens[np.lexsort((tokens, n))[:p]] if n.any() else tokens[:p]


def _allowed(na, nb, place_a, place_b, percent: int):
    """Length bound and positional bound: what two sets may still share is enough."""
    most = np.minimum(np.minimum(na - place_a, nb - place_b), np.minimum(na, nb))
    return (100 + percent) * most >= percent * (na + nb)


def candidate_pairs(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], n_buckets: int, cfg: JoinConfig) -> DataFrame:
    """(a, b, star, fits): pairs of set names; star marks those of a hub, a, with a set of its star; fits tells whether the length bound allows a link."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = "bucket int, hi binary, lo binary, at binary, place binary, sets binary, sizes binary"
    out = arrow_schema(docs.sparkSession, schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            key = np.concatenate(keys)
            lengths = np.array([len(k) for k in keys])
            owner = np.repeat(np.arange(len(keys)), lengths)
            place = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order, ends = _dealt(_bucket(key, n_buckets), n_buckets)
            name, size = np.array(names, dtype=np.int64), np.array(sizes, dtype=np.uint32)
            rows = []
            for b in range(n_buckets):
                at = order[ends[b] : ends[b + 1]]
                if len(at):
                    used, local = np.unique(owner[at], return_inverse=True)
                    hi, lo = _split48(key[at])
                    rows.append({"bucket": b, "hi": hi, "lo": lo, "at": local.astype(np.uint32).tobytes(), "place": place[at].astype(np.uint32).tobytes(), "sets": name[used].tobytes(), "sizes": size[used].tobytes()})
            return pa.RecordBatch.from_pylist(rows, schema=out)

        keys, names, sizes, held = [], [], [], 0
        for f1, t in _sets_of(batches, cfg):
            keys.append(ranked_prefix(t, known.value, prefix_length(len(t), cfg.percent)) >> np.uint64(16))
            names.append(f1)
            sizes.append(len(t))
            held += len(keys[-1])
            if held >= cfg.chunk_tokens:
                yield flush()
                keys, names, sizes, held = [], [], [], 0
        if keys:
            yield flush()

    pair_schema = "a long, b long, star boolean, fits boolean"
    pair_out = arrow_schema(docs.sparkSession, pair_schema)

    def meet(table: pa.Table) -> pa.Table:
        parts = []
        for r in table.select(["hi", "lo", "at", "place", "sets", "sizes"]).to_pylist():
            at = np.frombuffer(r["at"], dtype=np.uint32)
            parts.append((_join48(r["hi"], r["lo"]), np.frombuffer(r["sets"], dtype=np.int64)[at], np.frombuffer(r["place"], dtype=np.uint32).astype(np.int64), np.frombuffer(r["sizes"], dtype=np.uint32)[at].astype(np.int64)))
        key, name, place, size = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place, name, key))
        key, name, place, size = key[order], name[order], place[order], size[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
        key, name, place, size = key[fresh], name[fresh], place[fresh], size[fresh]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths = np.diff(np.r_[starts, len(key)])
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        hub, spoke, near = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        for length in range(2, cfg.small + 1):
            s = starts[lengths == length]
            for i in range(length):
                for j in range(i):
                    x, y = s + i, s + j
                    ok = _allowed(size[x], size[y], place[x], place[y], cfg.percent)
                    left.append(name[x][ok])
                    right.append(name[y][ok])
        for s, length in zip(starts[lengths > cfg.small], lengths[lengths > cfg.small]):
            part = np.arange(s, s + length)
            centre = s + int(np.lexsort((name[part], size[part], place[part]))[0])
            others = part[part != centre]
            hub.append(np.full(length - 1, name[centre]))
            spoke.append(name[others])
            near.append(_allowed(size[centre], size[others], 0, 0, cfg.percent))
        a, b = np.concatenate(left), np.concatenate(right)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        small = pa.table({"a": pair[:, 0], "b": pair[:, 1], "star": np.full(len(pair), False), "fits": np.full(len(pair), True)}, schema=pair_out)
        tied, at = np.unique(np.stack([np.concatenate(hub), np.concatenate(spoke)], axis=1), axis=0, return_index=True)
        stars = pa.table({"a": tied[:, 0], "b": tied[:, 1], "star": np.full(len(tied), True), "fits": np.concatenate(near)[at]}, schema=pair_out)
        return pa.concat_tables([small, stars])

    met = docs.select("text").mapInArrow(emit, schema).groupBy("bucket").applyInArrow(meet, pair_schema)
    return met.distinct()


def order_prefix(tokens: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """The prefix under the order that ``seed`` gives: its values' upper halves, ascending. Equal shingles have equal halves."""
    value = _mix(tokens ^ np.uint64(seed))
    p = prefix_length(len(value), percent)
    return np.sort(np.partition(value, p - 1)[:p]) >> np.uint64(32)


def linked(x: np.ndarray, y: np.ndarray, cfg: JoinConfig) -> bool:
    """Whether two sets are similar enough, by the exact count."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 100 * shared >= cfg.percent * (len(x) + len(y) - shared)


def _fetch(docs: DataFrame, sets: DataFrame, wanted: DataFrame, cfg: JoinConfig) -> DataFrame:
    """(f1, tokens) of the wanted fingerprints (column f1), read again from the documents that stand for them."""
    reps = sets.join(wanted, "f1", "left_semi").groupBy("f1").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id")).alias("r"))
    ids = durable(reps.select(F.col("r.doc_id").alias("id"), "f1"))
    n = ids.count()
    side = ids.select("id").distinct()
    # 16 bytes a row: beyond this size the join shuffles instead
    picked = docs.select("doc_id", "text").join(F.broadcast(side) if n <= 1_000_000 else side, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    orders = [f"prefix{k}" for k in range(len(cfg.orders))]
    schema = ", ".join(["f1 long", *[f"{o} array<int>" for o in orders], "tokens binary"])
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sets, size = [], [], 0

        def flush() -> pa.RecordBatch:
            prefixes = [[order_prefix(t, seed, cfg.percent).astype(np.uint32).view(np.int32) for t in sets] for seed in cfg.orders]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([names, *prefixes, [t.tobytes() for t in sets]], out)], schema=out)

        for f1, t in _sets_of(batches, cfg):
            names.append(f1)
            sets.append(t)
            size += len(t)
            if size >= cfg.chunk_tokens:
                yield flush()
                names, sets, size = [], [], 0
        if names:
            yield flush()

    found = picked.select("text").mapInArrow(run, schema).join(ids.select("f1"), "f1", "left_semi")
    return found.groupBy("f1").agg(*[F.first(c).alias(c) for c in (*orders, "tokens")])


def passing(pairs: DataFrame, tokens: DataFrame, order: int) -> DataFrame:
    """The pairs (a, b) that share a prefix shingle under a further order; only the prefixes move."""
    own = lambda c: tokens.select(F.col("f1").alias(c), F.col(f"prefix{order}").alias(f"{c}_prefix"))
    return pairs.join(own("a"), "a").join(own("b"), "b").where(F.arrays_overlap("a_prefix", "b_prefix")).select("a", "b")


def _verify(pairs: DataFrame, tokens: DataFrame, cfg: JoinConfig) -> DataFrame:
    """The pairs (a, b) that pass every order and are linked."""
    for k in range(len(cfg.orders)):
        pairs = passing(pairs, tokens, k)
    a, b = tokens.select(F.col("f1").alias("a"), F.col("tokens").alias("x")), tokens.select(F.col("f1").alias("b"), F.col("tokens").alias("y"))
    full = durable(pairs).join(a, "a").join(b, "b")

    def make():
        def work(rows: list[dict]) -> list[dict]:
            return [{"a": r["a"], "b": r["b"]} for r in rows if linked(np.frombuffer(r["x"], np.uint64), np.frombuffer(r["y"], np.uint64), cfg)]

        return work

    return map_arrow(full, make, "a long, b long")


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in order, and the place of the set that has each."""
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    return flat[order], np.repeat(np.arange(len(sets)), [len(t) for t in sets])[order]


def _shared(t: np.ndarray, postings: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """How many tokens of ``t`` each of n sets has."""
    flat, owner = postings
    lo, hi = np.searchsorted(flat, t), np.searchsorted(flat, t, side="right")
    k = hi - lo
    return np.bincount(owner[np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())], minlength=n)


def compare_blocks(rows: list[tuple[int, int, np.ndarray]], cols: list[tuple[int, int, np.ndarray]], cfg: JoinConfig) -> list[tuple[int, int]]:
    """Links between two blocks of (name, label, tokens) under the length bound, every order and the exact count; sets that are linked already are not compared."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    if not rows or not cols:
        return []
    n = len(cols)
    size, labels, names = np.array([len(s[2]) for s in cols]), np.array([s[1] for s in cols]), np.array([s[0] for s in cols])
    prefixes = [_postings([order_prefix(s[2], seed, cfg.percent) for s in cols]) for seed in cfg.orders]
    full = _postings([s[2] for s in cols])
    out = []
    for name, label, t in rows:
        open_ones = (labels != label) & (names != name) & _allowed(len(t), size, 0, 0, cfg.percent)
        for seed, postings in zip(cfg.orders, prefixes):
            if open_ones.any():
                open_ones &= _shared(order_prefix(t, seed, cfg.percent), postings, n) > 0
        if not open_ones.any():
            continue
        shared = _shared(t, full, n)
        for k in np.flatnonzero(open_ones & (100 * shared >= cfg.percent * (len(t) + size - shared))):
            x, y = find(label), find(int(labels[k]))
            if x != y:
                root[x] = y
                out.append((name, int(names[k])))
    return out


def _compare_stars(stars: DataFrame, labels: DataFrame, sets: DataFrame, docs: DataFrame, cfg: JoinConfig) -> DataFrame | None:
    """Links inside the stars (a, b) whose sets do not all have one label."""
    own = stars.select(F.col("a").alias("star"), F.col("b").alias("f1")).unionByName(stars.select(F.col("a").alias("star"), F.col("a").alias("f1")).distinct())
    named = own.join(labels.select(F.col("node").alias("f1"), F.col("component").alias("label")), "f1", "left").withColumn("label", F.coalesce("label", "f1"))
    member = durable(named.join(sets.groupBy("f1").agg(F.max("n").alias("n")), "f1"))
    by_label = member.groupBy("star", "label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    parts = lambda c: F.ceil(F.col(c) / cfg.block_tokens).cast("int")
    open_ones = by_label.groupBy("star").agg(F.max_by("label", "c").alias("most"), F.sum("n").alias("all"), (F.sum("n") - F.max_by("n", "c")).alias("beside"), F.count(F.lit(1)).alias("c")).where("c > 1")
    member = durable(member.join(open_ones.select("star", "most", parts("beside").alias("i_of"), parts("all").alias("j_of")), "star"))
    if member.isEmpty():
        return None
    tokens = _fetch(docs, sets, member.select("f1"), cfg).select("f1", "tokens")
    own = F.pmod(F.xxhash64("f1"), F.col("i_of")).cast("int"), F.pmod(F.xxhash64("f1"), F.col("j_of")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = member.where("label != most").select("star", own[0].alias("i"), every("j_of").alias("j"), "f1", "label", F.lit(True).alias("left"))
    right = member.select("star", every("i_of").alias("i"), own[1].alias("j"), "f1", "label", F.lit(False).alias("left"))
    dealt = left.unionByName(right).join(tokens, "f1")
    schema = "a long, b long"
    out = arrow_schema(docs.sparkSession, schema)

    def compare(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for r in table.select(["left", "f1", "label", "tokens"]).to_pylist():
            sides[r["left"]].append((r["f1"], r["label"], np.frombuffer(r["tokens"], np.uint64)))
        found = compare_blocks(sides[1], sides[0], cfg)
        return pa.table({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=out)

    return dealt.groupBy("star", "i", "j").applyInArrow(compare, schema)


def _named_sets(docs: DataFrame, cfg: JoinConfig) -> tuple[DataFrame, JoinConfig]:
    """The written sets of all rows, and the configuration with the salt that gives each set a name of its own."""
    while True:
        sets = durable(document_sets(docs, cfg))
        if sets.groupBy("f1").agg(F.min("f2").alias("lo"), F.max("f2").alias("hi")).where("lo != hi").isEmpty():
            return sets, cfg
        cfg = replace(cfg, salt=cfg.salt + 1)


def _classified(docs: DataFrame, cfg: JoinConfig) -> DataFrame:
    """doc_id, key, n of every row, and best (none, doc_id, key) of its component: the smallest doc_id, nulls last; null for empty sets."""
    spark = docs.sparkSession
    sets, cfg = _named_sets(docs, cfg)
    total = sets.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // cfg.bucket_tokens))
    frequent = frequent_shingles(docs, n_buckets, cfg)
    pairs = durable(candidate_pairs(docs, frequent, n_buckets, cfg))
    wanted = pairs.where("fits").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tokens = durable(_fetch(docs, sets, wanted.select(F.explode(F.array("a", "b")).alias("f1")).distinct(), cfg))
    edges = durable(_verify(wanted, tokens, cfg))
    labels = components(edges)
    more = _compare_stars(pairs.where("star").select("a", "b"), labels, sets, docs, cfg)
    if more is not None:
        labels = components(edges.unionByName(more))
    # classes of equal sets, then components of classes: both are summed before rows meet again
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = sets.where("n > 0").groupBy("f1", "f2").agg(F.min(rank).alias("first"))
    named = classes.join(labels.select(F.col("node").alias("f1"), "component"), "f1", "left").withColumn("component", F.coalesce("component", "f1"))
    first = named.groupBy("component").agg(F.min("first").alias("best"))
    by_class = named.join(first, "component").select("f1", "f2", "best")
    return sets.join(by_class, ["f1", "f2"], "left").select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("best")).alias("best"))


def similarity_classes(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = _classified(docs, cfg)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, cfg: JoinConfig = JoinConfig()) -> DataFrame:
    """``docs`` with one row of each component: one of the smallest doc_id, nulls last; rows without words all stay."""
    rows = _classified(docs, cfg).where("n > 0").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))).alias("best"))
    # the rows that go, and those that stay but are repeated with id and text
    some = durable(rows.groupBy("__id", "__key", "best").agg(F.count(F.lit(1)).alias("n")).where("not best or n > 1").select("__id", "__key", "best"))
    # 24 bytes a row: beyond this size the join shuffles instead
    side = F.broadcast(some) if some.count() <= 1_000_000 else some
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    kept = docs.join(side, same, "left_anti")
    again = some.where("best")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
