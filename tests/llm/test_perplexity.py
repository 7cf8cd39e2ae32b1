"""The model against a plain Kneser-Ney by dictionaries, base counts against loops, bands by hand."""

import math
import random
from collections import Counter, defaultdict

import pytest

from varve.llm import perplexity
from varve.llm.perplexity import ORDER, GramCounts, PerplexityConfig, base_counts, judge_quality, perplexity_bands, train_perplexity


def plain(text):
    out, white = [], False
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            out += [" "] * (not white)
            white = True
        else:
            out.append("�" if c in "\x00\x02" else "0" if c in "0123456789" else c)
            white = False
    return "\x02" * (ORDER - 1) + "".join(out)


class Plain:
    """Interpolated modified Kneser-Ney, from definitions."""

    def __init__(self, texts, min_docs):
        count, docs = Counter(), Counter()
        for t in map(plain, texts):
            grams = [t[i : i + ORDER] for i in range(len(t) - ORDER + 1)]
            count.update(grams)
            docs.update(set(grams))
        self.c, keep = {ORDER: count}, {ORDER: dict(docs)}
        for n in range(ORDER - 1, 0, -1):
            self.c[n], keep[n] = Counter(), defaultdict(int)
            for g in self.c[n + 1]:
                self.c[n][g[1:]] += 1
                keep[n][g[1:]] = max(keep[n][g[1:]], keep[n + 1][g])
        self.keep = {n: {g for g, d in keep[n].items() if d >= min_docs} for n in keep}
        self.d = {}
        for n in self.c:
            k = Counter(self.c[n].values())
            y = k[1] / (k[1] + 2 * k[2]) if k[1] + k[2] else 0
            d = [i - (i + 1) * y * k[i + 1] / k[i] if k[i] else 0 for i in (1, 2, 3)]
            self.d[n] = [x if 0 < x < i else i / 2 for i, x in enumerate(d, 1)]
        self.total = {n: Counter() for n in self.c}
        self.used = {n: Counter() for n in self.c}
        for n in self.c:
            for g, c in self.c[n].items():
                self.total[n][g[:-1]] += c
                if g in self.keep[n]:
                    self.used[n][g[:-1]] += c - self.d[n][min(c, 3) - 1]

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / (len(self.c[1]) + 1)
        context = g[:-1]
        if not self.used[n][context]:
            return self.p(g[1:])
        own = (self.c[n][g] - self.d[n][min(self.c[n][g], 3) - 1]) / self.total[n][context] if g in self.keep[n] else 0
        return own + (1 - self.used[n][context] / self.total[n][context]) * self.p(g[1:])

    def log_perplexity(self, text):
        t = plain(text)
        return -sum(math.log(self.p(t[i : i + ORDER])) for i in range(len(t) - ORDER + 1)) / (len(t) - ORDER + 1)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcde fg é") for _ in range(rng.randrange(1, 60))) for _ in range(n)] + ["a\x02b\x00 \n\tc", "ab", "x", "abab" * 30, "call 123 or 456"]


@pytest.mark.parametrize("min_docs", [1, 2])
def test_equals_plain_kneser_ney(spark, min_docs):
    en, de = texts(1, 60), texts(2, 40)
    rows = spark.createDataFrame([("=en", t) for t in en] + [("", t) for t in de], "lang string, text string")
    model = train_perplexity(rows, PerplexityConfig(min_docs=min_docs))
    for lang, own in (("=en", en), ("", de)):
        want = Plain(own, min_docs)
        for t in [*own, "never seen ñ ñ zzz", "ab cd"]:
            assert model.log_perplexity(t, lang) == pytest.approx(want.log_perplexity(t), abs=1e-5), t
        seen = {g[:-1] for g in want.c[ORDER]}
        for context in sorted(seen)[:20]:  # probabilities of all characters and an unknown one sum to 1
            assert sum(want.p(context + c) for c in want.c[1]) + want.p(context + "☃") == pytest.approx(1)


def test_the_bound_raises_the_threshold(spark):
    own = texts(4, 60)
    rows = spark.createDataFrame([("=en", t) for t in own], "lang string, text string")
    docs = Counter(g for t in map(plain, own) for g in {t[i : i + ORDER] for i in range(len(t) - ORDER + 1)})
    few = sum(d >= 3 for d in docs.values())
    model, want = train_perplexity(rows, PerplexityConfig(max_grams=few)), Plain(own, 3)
    assert few < sum(d >= 2 for d in docs.values())
    assert all(model.log_perplexity(t, "=en") == pytest.approx(want.log_perplexity(t), abs=1e-5) for t in own)


def test_pieces_change_nothing(spark, monkeypatch):
    own = texts(5, 30)
    rows = spark.createDataFrame([("=en", t) for t in own], "lang string, text string")
    model = train_perplexity(rows)
    whole = [model.log_perplexity(t, "=en") for t in own]
    one = GramCounts()
    [one.add(t) for t in own]
    one.settle()
    monkeypatch.setattr(perplexity, "PIECE", 7)
    assert [model.log_perplexity(t, "=en") for t in own] == pytest.approx(whole, abs=1e-9)
    two = GramCounts()
    [two.add(t) for t in own]
    two.settle()
    for a, b in zip(one.parts[0], two.parts[0], strict=True):
        assert a.tolist() == b.tolist()


def slow_counts(text):
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r") and line in lines[:i])
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] >= 2 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts():
    rng = random.Random(8)
    odd = ["", " \n ", "a", "a a a", "a a a a", "a b c a b c", "x\n x\nx\n\n\nx", "é# é# é#\té# *|<>", "one\r\ntwo\r\none\r\n", " a b"]
    for t in odd + ["".join(rng.choice("ab \n#") for _ in range(rng.randrange(200))) for _ in range(200)]:
        assert base_counts(t) == slow_counts(t), t


def test_bands(spark):
    x = [1.0] * 20 + [1.1] * 30 + [1.3] * 20 + [9.0]
    rows = [("=en", False, v) for v in x] + [("=en", True, 50.0), ("=en", False, None)] + [("=xx", False, 1.0)] * 5
    got = perplexity_bands(spark.createDataFrame(rows, "lang string, base_failed boolean, log_perplexity double"), PerplexityConfig(width=2)).collect()
    # median 1.1; deviations 0 thirty times, .1 twenty times, .2 twenty times: their median is .1
    assert [(r.lang, round(r.lower, 5), round(r.upper, 5)) for r in got] == [("=en", round(1.1 - 0.29652, 5), round(1.1 + 0.29652, 5))]


def test_rules(spark, make_docs):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    clean = [(k, " ".join(rng.choice(words) for _ in range(120)), rng.choice(["en", None])) for k in range(120)]
    strange = "".join(chr(rng.randrange(0x4E00, 0x9000)) + rng.choice(["", " "]) for _ in range(900))
    phrase = " ".join(words[:3] * 40)
    docs = make_docs([*clean, (900, strange, "en"), (901, strange + "x", None), (902, phrase, "en"), (903, None, "en"), (904, "", "en"), (905, " \n ", "en"), (None, clean[0][1], "en"), (0, clean[0][1], "en"), (906, strange + "lone", "zz")])
    got = judge_quality(docs).toPandas()
    assert len(got) == docs.count()
    by = got.dropna(subset=["doc_id"]).set_index("doc_id")
    assert by.loc[list(range(1, 120)), "kept"].all() and not by.loc[[900, 901, 902, 903, 904, 905], "kept"].any()
    assert by.loc[906, "kept"] and not by.loc[900, "base_failed"] and by.loc[902, "base_failed"]
    assert by.loc[[903, 904, 905], "log_perplexity"].isna().all() and (by.loc[[903, 904, 905], "n_words"] == 0).all()
    again = judge_quality(docs.withColumnRenamed("extra", "kept").repartition(3)).toPandas()
    key = lambda f: sorted(map(str, f.round(9).itertuples(index=False, name=None)))
    assert key(again) == key(got)


def test_no_rows(spark, make_docs):
    assert judge_quality(make_docs([])).count() == 0
    assert judge_quality(make_docs([(1, None), (2, "")])).where("kept").count() == 0


@pytest.mark.parametrize("most", [100])
def test_a_model_beyond_the_bound_is_taken_in_blocks(spark, most):
    """No gram is left out: every row's log perplexity is that of the whole model."""
    rows = [(k, t, "en" if k % 3 else None) for k, t in enumerate(texts(6, 80) * 3)]
    rows += [rows[5], rows[5], (None, "abc de", "en"), (None, "abc dee", "en"), (900, None, "en"), (901, " \n", None), (7, "same id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda r: (str(r.doc_id), r.n_words, r.word_chars, r.log_perplexity or 0.0)
    whole, got = (sorted(judge_quality(docs, PerplexityConfig(max_grams=m)).collect(), key=key) for m in (1_000_000, most))
    assert len(got) == len(rows)
    for a, b in zip(whole, got, strict=True):
        assert a[:8] == b[:8]
        assert (a.log_perplexity is None) == (b.log_perplexity is None)
        assert a.log_perplexity is None or b.log_perplexity == pytest.approx(a.log_perplexity, abs=1e-6)
