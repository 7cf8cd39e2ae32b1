"""Contamination against a scan of all windows at all places."""

import hashlib
import random
import re

import pytest

from varve.llm.decontam import DecontaminationConfig, drop_contaminated, find_contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                x = tuple(w[k : k + size])
                if x in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(1)
    vocabulary = ["the", "of"] * 20 + [f"w{k}é" for k in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(rng.choice([3, 8, 13, 14, 40])))) for k in range(30)] + [(90, None), (91, "?!"), (92, "the " * 20), (5, "w1é, W2é"), (None, "w3É w4é")]
    docs = []
    for d in range(120):
        t = text(rng.randint(0, 300))
        if d % 3 == 0:
            item = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(t))
            t[at:at] = item[: rng.choice([len(item), max(1, len(item) - 2)])]
        docs.append((d, "- ".join(t).upper() if d % 5 == 0 else " ".join(t)))
    return docs + [(500, None), (501, ""), (None, "w1é w2é"), (7, docs[7][1])], items


@pytest.mark.parametrize("block", [2_000_000, 60, 7])
def test_equals_brute_force(spark, make_docs, case, block):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    cfg = DecontaminationConfig(block_words=block)
    got = sorted((tuple(r) for r in find_contamination(make_docs(docs), bench, cfg).collect()), key=str)
    want = brute(docs, items)
    assert got == want
    clean = drop_contaminated(make_docs(docs), bench, cfg)
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[5])


def test_empty_tables(spark, make_docs, case):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(make_docs([]), none).count() == 0
    assert not any(r.contaminated for r in find_contamination(make_docs(case[0][:9]), none).collect())


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_rows_that_share_an_id_are_judged_each(spark, make_docs, case, block):
    items = case[1]
    bad = max((t or "" for _, t in items), key=len)
    docs = [(None, bad), (None, "clean text without id"), (3, bad), (3, "clean text of that id"), (4, "other")]
    clean = drop_contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), DecontaminationConfig(block_words=block))
    assert sorted(r.text for r in clean.collect()) == ["clean text of that id", "clean text without id", "other"]
