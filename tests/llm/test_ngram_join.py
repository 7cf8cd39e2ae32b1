"""The n-gram join against all pairs."""

import random

import numpy as np
import pytest

from varve.llm.components import components
from varve.llm import ngram_join
from varve.llm.ngram_join import JoinConfig, compare_blocks, keep_one_of_each, linked, passing, shingle_set, similarity_classes


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[m][0] for m in range(len(rows)) if find(m) == find(k) and sets[m][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=str)


def corpus(seed, groups=12, copies=9, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(12)]
    rows, n = [], 0
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(size)] + (passage if g % 2 else [])
        for c in range(rng.randint(1, copies) if g else 40):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text = text[: int(len(text) * rng.uniform(0.75, 1))]
            rows.append((n, " ".join(text) if c % 2 else "\t".join(text).upper()))
            n += 1
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \n "), (1003, "One two"), (1004, "one  TWO"), (1004, "one two"), (None, "one two"), (None, None), (1005, "É é"), (1006, "é é"), (None, "alone here only")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, make_docs, seed):
    rows = corpus(seed) + EDGES
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity_classes(make_docs(rows), JoinConfig(small=4, block_tokens=500)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_one_of_each(spark, make_docs):
    assert similarity_classes(make_docs([])).count() == 0
    rows = corpus(3, 6, 4)
    kept = {r.doc_id for r in keep_one_of_each(make_docs(rows)).collect()}
    assert kept == {c for _, _, c in brute(rows)}


def test_blocks_find_links_that_pairs_find():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = []
    for k in range(30):
        t = base.copy()
        t[rng.integers(0, 80, rng.integers(0, 9))] = rng.integers(0, 2**63, dtype=np.uint64)
        sets.append((k, k, np.unique(t)))
    cfg = JoinConfig()
    found = compare_blocks(sets, sets, cfg)
    pairs = [(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and linked(a[2], b[2], cfg)]

    def parts(edges):
        root = list(range(30))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [rb if r == ra else r for r in root]
        return {frozenset(i for i in range(30) if root[i] == r) for r in root}

    assert parts(found) == parts(pairs) and len(found) < 30


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_sets():
    assert len(shingle_set(None, 5)) == 0 and len(shingle_set("a b", 5)) == 1
    assert len(shingle_set("a b c d e f a b c d e", 5)) == len(shingles("a b c d e f a b c d e"))
    assert (shingle_set("A b\tc D e f", 5) == shingle_set("a B c\nd E F", 5)).all()


def test_keeps_one_row_where_ids_repeat_or_lack(spark, make_docs):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(1, text(1)), (None, text(1)), (None, text(2)), (2, text(1)), (2, text(3)), (None, text(4)), (None, text(4)), (5, text(5)), (5, text(5)), (6, ""), (6, ""), (None, None)]
    got = sorted(((r.doc_id, r.text) for r in keep_one_of_each(make_docs(rows)).collect()), key=str)
    assert got == sorted([(1, text(1)), (None, text(2)), (2, text(3)), (None, text(4)), (5, text(5)), (6, ""), (6, ""), (None, None)], key=str)


def test_every_order_takes_pairs_away_but_no_link(spark, make_docs, monkeypatch):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(100000)}"
    rows = []
    for g in range(120):
        # two texts that share one rare shingle only, and a near copy of the first
        shared = [word() for _ in range(5)]
        first = [word() for _ in range(60)] + shared
        second = shared + [word() for _ in range(60)]
        near = list(first)
        near[3] = word()
        rows += [(3 * g, " ".join(first)), (3 * g + 1, " ".join(second)), (3 * g + 2, " ".join(near))]
    counts = []

    def counting(pairs, tokens, order):
        out = passing(pairs, tokens, order)
        counts.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "passing", counting)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity_classes(make_docs(rows)).collect()), key=str)
    assert got == brute(rows)
    (all_pairs, after_one), (again, after_two) = counts[:2]
    print("pairs before and after each further order", counts[:2])
    assert all_pairs > after_one == again >= after_two >= 120


def test_sets_with_one_name_are_named_anew(spark, make_docs, monkeypatch):
    rows = corpus(5, 4, 4)
    docs = make_docs(rows)
    made = {}

    def sets(docs, cfg, own=ngram_join.document_sets):
        made[cfg.salt] = True
        out = own(docs, cfg)
        return out.withColumn("f1", out["f1"] % 3) if cfg.salt == 0 else out

    monkeypatch.setattr(ngram_join, "document_sets", sets)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity_classes(docs).collect()), key=str)
    assert got == brute(rows) and sorted(made) == [0, 1]
