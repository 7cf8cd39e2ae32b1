"""Fingerprints: the edited text against a plain list, and properties of the digest."""

import hashlib
import random

import numpy as np

from varve.llm.fingerprint import bucket_counts, fingerprint, fingerprint_documents, likeness


def texts(seed, n):
    rng = random.Random(seed)
    return [(k * 7 - 20, "".join(rng.choice("abc dé漢") for _ in range(rng.randint(0, 400)))) for k in range(n)]


def brute(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        a, b, c = (fingerprint(x.encode()) for x in (t, edited, after))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c))
    return out


def test_equals_a_plain_list(spark, make_docs):
    rows = texts(1, 57) + [(1000, None), (999, "")]
    random.Random(2).shuffle(rows)
    got = {r.doc_id: tuple(r)[1:] for r in fingerprint_documents(make_docs(rows).repartition(3)).collect()}
    assert got == brute(rows)


def test_odd_tables(spark, make_docs):
    assert fingerprint_documents(make_docs([])).count() == 0
    one = fingerprint_documents(make_docs([(1, "abcabc")])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcaab").hexdigest() and one[0].near_next == 1
    got = fingerprint_documents(make_docs([(1, "abc"), (1, "abd"), (None, "xyz"), (1, "abc")])).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 3


def test_likeness():
    rng = np.random.default_rng(1)
    a = bytes(rng.integers(97, 123, 3000, dtype=np.uint8))
    b = a[:2900] + bytes(rng.integers(97, 123, 100, dtype=np.uint8))
    c = bytes(rng.integers(65, 91, 3000, dtype=np.uint8))
    fa, fb, fc = map(fingerprint, (a, b, c))
    assert len(fa) == 70 and likeness(fa, fa) == 1 and likeness(fa, fb) == likeness(fb, fa)
    assert likeness(fa, fb) > 0.8 > likeness(fa, fc) >= 0
    big = a * 800
    assert bucket_counts(big).sum() == 3 * (len(big) - 3)


def plain_digest(data):
    """The digest by loops over byte windows."""
    data = data + b"\0" * (4 - len(data)) if len(data) < 4 else data
    counts = [0] * 128
    for i in range(3, len(data)):
        p, q, r, s = data[i - 3 : i + 1]
        for salt, (x, y) in enumerate(((r, q), (r, p), (q, p)), 1):
            h = ((x << 16 | y << 8 | s) + salt * 0x2545F491) * 0x9E3779B1 % 2**32
            h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
            counts[h >> 25] += 1
    return counts


def test_digest_equals_loops():
    rng = random.Random(11)
    for text in ["", "a", "abc", "abcd", "é漢" * 40, *("".join(rng.choice("abc dé漢\n") for _ in range(n)) for n in (5, 60, 700))]:
        data = text.encode()
        counts = plain_digest(data)
        assert bucket_counts(data).tolist() == counts
        ordered = sorted(counts)
        quartiles = ordered[31], ordered[63], ordered[95]
        bits = "".join(f"{sum(c > q for q in quartiles):02b}" for c in counts)
        made = fingerprint(data)
        assert made[6:] == f"{int(bits, 2):064x}"
        assert int(made[2:4], 16) == min(15, 16 * quartiles[0] // (quartiles[2] + 1)) * 16 + min(15, 16 * quartiles[1] // (quartiles[2] + 1))
