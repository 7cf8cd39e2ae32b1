"""Toxicity and language identification: held-out accuracy and defined results."""

import math
import random
import re
import zlib

import numpy as np
import zstandard

from varve.llm.langid import LangIdConfig, identify_language, train_language_id
from varve.llm.toxicity import LabelModel, fit_linear, reject_toxic, score_toxicity, train_toxicity


def corpus(seed, n=600):
    rng = random.Random(seed)
    parts = {"en": "the of and ing tion er re".split(), "xx": "zu sch ich heit ge ver en".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(n):
        lang = rng.choice(["en", "xx"])
        words = [word(lang) for _ in range(rng.randint(8, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(max(2, len(words) // 12)):
                words.insert(rng.randrange(len(words)), "vraz" + word(lang) if lang == "xx" else rng.choice(["idiot", "blorp"]))
        docs.append((k, " ".join(words), lang))
        labels.append((k, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, make_docs):
    docs, labels = corpus(1)
    table = spark.createDataFrame(labels + [(9999, 1), (0, None)], "doc_id long, toxic int")
    extra = [(5000, None, "en"), (5001, "", "en"), (None, "plain words here", "en"), (5002, "word " * 50000, "en")]
    d = make_docs(docs + extra)
    model = train_toxicity(d, table)
    got = {r.doc_id: r for r in score_toxicity(d, model).collect()}
    assert all(r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1) for i, r in got.items())
    truth = dict(labels)
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert not any(got[i].predicted for i in (5000, 5001, None, 5002))
    clean = reject_toxic(d, model)
    assert clean.columns == d.columns and clean.count() == sum(not r.predicted for r in got.values())
    accuracy = dict(zip(model.terms, model.label_model.accuracy))
    assert max(accuracy.values()) > 0.9


def test_toxicity_without_labels_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train_toxicity(make_docs([(1, "a")]), none)
    got = {r.doc_id: r.predicted for r in score_toxicity(make_docs([(1, "you idiot, moron, scum"), (2, "fine"), (3, None)]), model).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert score_toxicity(make_docs([]), model).count() == 0


def test_label_model_weighs_copies_as_one():
    rng = np.random.default_rng(1)
    gold = (rng.random(800) < 0.3).astype(int)
    vote = lambda right: np.where(rng.random(800) < right, np.where(gold, 1, -1), np.where(gold, -1, 1))
    good, other, weak = vote(0.9), vote(0.85), vote(0.6)
    one, four = LabelModel(), LabelModel()
    q1 = one.fit(np.stack([good, other, weak], axis=1).astype(np.int8), gold)
    q4 = four.fit(np.stack([good, other, weak, weak, weak, weak], axis=1).astype(np.int8), gold)
    assert ((q4 > 0.5) == gold).mean() > 0.9 and np.abs(q1 - q4).mean() < 0.03
    # each copy but one depends on a copy
    assert sum(four.parent[j] in (2, 3, 4, 5) for j in (2, 3, 4, 5)) == 3
    beta = fit_linear(np.column_stack([np.ones(800), good]), q4, 0.1)
    assert beta[1] > 1


def test_label_model_finds_accuracies_beyond_its_labels():
    rng = np.random.default_rng(2)
    truth = (rng.random(4000) < 0.5).astype(int)
    gold = np.where(rng.random(4000) < 0.1, 1 - truth, truth)  # a tenth of the labels is wrong
    right = (0.95, 0.9, 0.9, 0.85, 0.8)
    votes = np.stack([np.where(rng.random(4000) < 0.2, 0, np.where(rng.random(4000) < r, 2 * truth - 1, 1 - 2 * truth)) for r in right], axis=1).astype(np.int8)
    model = LabelModel(annotator=0.9)
    q = model.fit(votes, gold)
    assert ((q > 0.5) == truth).mean() > ((gold == truth).mean() + 0.04)
    assert np.abs(model.rates[1][2] - 0.8 * np.array(right)).max() < 0.05


def test_label_model_posterior_is_the_product_of_its_tables():
    rng = np.random.default_rng(3)
    gold = (rng.random(300) < 0.4).astype(int)
    votes = np.stack([np.where(rng.random(300) < 0.3, 0, np.where(rng.random(300) < 0.8, 2 * gold - 1, 1 - 2 * gold)) for _ in range(4)], axis=1).astype(np.int8)
    votes = np.column_stack([votes, votes[:, 0]])
    model = LabelModel()
    q = model.fit(votes, gold)
    for row in range(20):
        joint = [1 - model.prior, model.prior]
        for y in (0, 1):
            joint[y] *= model.annotator if gold[row] == y else 1 - model.annotator
            for j, v in enumerate(votes[row]):
                p = model.parent[j]
                joint[y] *= model.rates[y][v + 1, j] if p < 0 else model.given[y][votes[row, p] + 1, v + 1, j]
        assert abs(joint[1] / sum(joint) - q[row]) < 1e-9


def plain_score(text, model):
    """The classifier's score by word lists and loops."""
    low = (text or "").lower()
    words = re.findall(r"[^\W\d_]+", low)
    hits, places = [], set()
    for k, term in enumerate(model.terms):
        least, body = int(term[0]), term[2:]
        at = [i for i, w in enumerate(words) if (w == body[1:] if body[0] == "=" else w.startswith(body))]
        places |= set(at)
        if len(at) >= least:
            hits.append(k)
    n = max(1, low.count(" ") + low.count("\n") + 1)
    marks = (text or "").count("!")
    upper = sum(c.isupper() for c in text or "") if marks > 4 else 0
    share = len(places) / n
    x = [float(k in hits) for k in range(len(model.terms))]
    x += [1.0, float(len(hits) > 0), math.log1p(len(places)), min(1.0, share / 0.01), min(1.0, share / 0.003), float(len(places) >= 2), min(1.0, marks / n), upper / max(1, len(text or ""))]
    z = sum(a * b for a, b in zip(x, model.beta))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_equal_a_plain_reading(spark, make_docs):
    docs, labels = corpus(7, 300)
    docs += [(900, "IDIOT!!!!!! You, blorp-blorp idiots", "en"), (900, "idiot", "en"), (None, None, "en"), (901, "", "en")]
    d = make_docs(docs)
    model = train_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = sorted((str(r.doc_id), round(r.score, 9)) for r in score_toxicity(d, model).collect())
    assert got == sorted((str(i), round(plain_score(t, model), 9)) for i, t, _ in docs)


def test_rejecting_keeps_columns_that_clash(spark, make_docs):
    docs, labels = corpus(8, 200)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    clash = make_docs(docs).withColumnsRenamed({"extra": "score", "source": "toxic"})
    model = train_toxicity(clash, table)
    clean = reject_toxic(clash, model)
    assert clean.columns == clash.columns and 0 < clean.count() < 200


def test_language_on_held_out_rows(spark, make_docs):
    docs, _ = corpus(2)
    extra = [(7000, None, "en"), (7001, "123 ... !", "xx"), (7002, "", "en"), (7003, "theing oftion ander", None), (None, "schich heitge veren zusch", "xx")]
    d = make_docs(docs + extra)
    got = {r.doc_id: r for r in identify_language(d, train_language_id(d)).collect()}
    truth = {i: lang for i, _, lang in docs}
    held = [i for i in truth if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (7000, 7001, 7002))
    assert got[7003].lang_pred == "en" and got[None].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = train_language_id(make_docs([]))
    assert identify_language(make_docs([(1, "abc")]), empty).first().lang_pred == "und"
    assert identify_language(make_docs([]), empty).count() == 0


def test_languages_of_long_documents_and_rows_without_ids_are_learned(spark, make_docs):
    rng = random.Random(4)
    text = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    here, there = "the of and ing tion er re".split(), "zu sch ich heit ge ver en".split()
    rows = [(None, text(here, 40), "aa") for _ in range(30)] + [(1, text(there, 4000), "bb") for _ in range(30)] + [(8, "", "cc")]
    cfg = LangIdConfig(docs_per_language=10, max_chars=900)
    model = train_language_id(make_docs(rows), cfg)
    assert list(model.contents) == ["aa", "bb"]
    assert all(len(c) <= 10 * (cfg.max_chars + 1) for c in model.contents.values())
    got = [r.lang_pred for r in identify_language(make_docs([(1, text(here, 30)), (2, text(there, 30))]), model).collect()]
    assert sorted(got) == ["aa", "bb"]


def test_language_equals_plain_compression(spark, make_docs):
    docs, _ = corpus(6, 200)
    model = train_language_id(make_docs(docs), LangIdConfig(docs_per_language=50))
    cfg = model.config
    want = {}
    for i, text, _ in docs:
        letters = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        sizes = {}
        for lang, content in model.contents.items():
            of = lambda piece: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters.from_level(1, source_size=cfg.piece, dict_size=len(content), strategy=zstandard.STRATEGY_FAST, min_match=cfg.min_match, target_length=1, write_content_size=0, write_checksum=0, write_dict_id=0)).compress(piece)  # noqa: E731, B023
            sizes[lang] = sum(len(of(letters[k : k + cfg.piece])) for k in range(0, len(letters), cfg.piece))
        want[i] = min(model.contents, key=lambda g: (sizes[g], list(model.contents).index(g)))
    got = {r.doc_id: r.lang_pred for r in identify_language(make_docs(docs), model).collect()}
    assert got == want
