"""Toxicity by weak supervision.

Many lexicon and pattern voters, mined from a bounded sample of labelled rows, vote on documents. A
generative label model estimates the voters' accuracies and correlations by expectation and maximisation.
A linear classifier is trained on the posterior labels; it alone scores documents.

Edge cases: a null or empty text is scored like a text without words (low); a null doc_id is kept and
counts as the empty text for the split; repeated rows are scored alike; a label that is null is no
label, and labels that contradict each other for one document count as toxic; without any toxic
training label only the seed lexicon votes. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, held_out, map_arrow

WORD = re.compile(r"[^\W\d_]+")

#: A small seed lexicon of insults that the miner extends from labelled rows.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting")


@dataclass(frozen=True)
class ToxicityConfig:
    """``max_positive`` and ``max_negative`` bound the labelled rows that the model is fitted on, ``max_voters`` the number of mined voters, which is the number of the classifier's features."""

    max_positive: int = 4000
    max_negative: int = 8000
    min_support: int = 5
    min_share: float = 0.01
    min_precision: tuple[float, ...] = (0.92, 0.8, 0.8)
    prefix_lengths: tuple[int, ...] = (4, 5, 6, 7, 8)
    max_voters: int = 300
    threshold: float = 0.7
    l2: float = 0.1


def _terms(text: str | None, lengths: tuple[int, ...], most: int) -> set[str]:
    """``k:=word`` and ``k:beginning`` for what occurs ``k`` times at least, k from 1 to ``most``."""
    n: Counter[str] = Counter()
    for w, c in Counter(WORD.findall((text or "").lower())).items():
        n["=" + w] += c
        for length in lengths:
            if len(w) >= length:
                n[w[:length]] += c
    return {f"{k}:{t}" for t, c in n.items() for k in range(1, min(c, most) + 1)}


class Matcher:
    """Finds lexicon terms (``k:=word`` or ``k:beginning``) in a text with one Aho-Corasick pass."""

    def __init__(self, terms: list[str]):
        self.least = [int(t.partition(":")[0]) for t in terms]
        self.whole = [t.partition(":")[2][0] == "=" for t in terms]
        found: dict[str, list[int]] = {}
        for k, t in enumerate(terms):
            found.setdefault(t.partition(":")[2].lstrip("="), []).append(k)
        self.machine = ahocorasick.Automaton()
        for t, ks in found.items():
            self.machine.add_word(t, (len(t), ks))
        if found:
            self.machine.make_automaton()
        self.empty = not found

    def count(self, lowered: str) -> tuple[list[int], int]:
        """The terms that occur often enough, and the number of words that begin with any term."""
        n: dict[int, int] = {}
        words = set()
        if self.empty:
            return [], 0
        for end, (length, ks) in self.machine.iter(lowered):
            start = end - length + 1
            if start and lowered[start - 1].isalpha():
                continue
            for k in ks:
                if not self.whole[k] or end + 1 == len(lowered) or not lowered[end + 1].isalpha():
                    n[k] = n.get(k, 0) + 1
                    words.add(start)
        return [k for k, c in n.items() if c >= self.least[k]], len(words)


PATTERNS = ("one_word", "several_words", "dense_words", "no_word", "capitals", "exclamation", "sparse_words")


def describe(text: str | None, matcher: Matcher) -> tuple[list[int], list[float]]:
    """The terms that hit, and measures: words hit, terms hit, words hit a word, exclamation marks a word, share of capitals."""
    text = text or ""
    lowered = text.lower()
    hits, found = matcher.count(lowered)
    words = max(1, lowered.count(" ") + lowered.count("\n") + 1)
    marks = text.count("!")
    upper = sum(map(str.isupper, text)) if marks > 4 else 0
    return hits, [float(found), float(len(hits)), found / words, marks / words, upper / max(1, len(text))]


def _votes(hits: list[int], m: list[float], n_terms: int) -> np.ndarray:
    """+1 toxic, -1 not, 0 abstains; the terms first, then PATTERNS."""
    v = np.zeros(n_terms + len(PATTERNS), dtype=np.int8)
    v[hits] = 1
    v[n_terms:] = (m[0] > 0, m[0] >= 3, m[2] > 0.006, -(m[0] == 0), m[4] > 0.3, m[3] > 0.1, -(m[2] < 0.003))
    return v


def features(hits: list[int], m: list[float], n_terms: int) -> np.ndarray:
    x = np.zeros(n_terms + 8)
    x[hits] = 1.0
    x[n_terms:] = (1.0, m[1] > 0, math.log1p(m[0]), min(1.0, m[2] / 0.01), min(1.0, m[2] / 0.003), m[0] >= 2, min(1.0, m[3]), m[4])
    return x


class LabelModel:
    """A generative model of the votes: given the class, each voter depends on at most one other.

    The dependences are the maximum spanning forest over the mutual information of voters within the
    classes; P(vote | class, vote of the voter it depends on) are the voters' accuracies and correlations,
    estimated by expectation and maximisation. A vote that a correlated voter has already cast is expected
    in both classes and so says little more. An abstention is a vote of its own. The labels are the votes of
    one more, independent voter whose accuracy is given (``annotator``), so that many voters can outvote a
    label but cannot give the classes another meaning. The share of toxic rows stays that of the labels.
    """

    def __init__(self, rounds: int = 8, annotator: float = 0.95, least_information: float = 0.01, strength: float = 2.0):
        self.rounds, self.annotator, self.least_information, self.strength = rounds, annotator, least_information, strength

    def fit(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """Posterior probability of toxicity of each row with label ``gold`` (0 or 1)."""
        n, k = votes.shape
        seen = np.concatenate([votes == v for v in (-1, 0, 1)], axis=1).astype(float)  # column v * k + j: voter j cast v
        q = np.where(gold == 1, self.annotator, 1 - self.annotator)
        self.prior = float(np.clip(gold.mean(), 1e-4, 1 - 1e-4))
        for r in range(self.rounds):
            together = [(seen.T @ (seen * w[:, None])).reshape(3, k, 3, k) for w in (1 - q, q)]
            alone = [np.einsum("vjvj->vj", t) for t in together]
            weight = [float((1 - q).sum()), float(q.sum())]
            # few rows of a class shrink its rates to even odds against never, so that no vote is taken as proof
            self.rates = [(a + np.array([[0.1], [1.0], [0.1]])) / (w + 1.2) for a, w in zip(alone, weight)]
            if r < 2:
                self.parent = self._forest(together, alone, weight)
            self.given = [self._conditional(t, a, rate) for t, a, rate in zip(together, alone, self.rates)]
            q = self.posterior(votes, gold)
        up0, up1 = self.rates[0][2], self.rates[1][2]
        self.accuracy = up1 * self.prior / (up1 * self.prior + up0 * (1 - self.prior))
        return q

    def _forest(self, together: list[np.ndarray], alone: list[np.ndarray], weight: list[float]) -> np.ndarray:
        """For each voter the one it depends on, or -1."""
        k = alone[0].shape[1]
        information = np.zeros((k, k))
        for t, a, w in zip(together, alone, weight):
            if w > 0:
                expected = a[:, :, None, None] * a[None, None, :, :] / w
                with np.errstate(divide="ignore", invalid="ignore"):
                    information += np.where(t > 0, t * np.log(t / expected), 0.0).sum(axis=(0, 2)) / sum(weight)
        np.fill_diagonal(information, 0)
        parent = np.full(k, -1)
        best, by, left = np.zeros(k), np.full(k, -1), np.ones(k, dtype=bool)
        while left.any():
            j = int(np.argmax(np.where(left, best, -1.0)))
            left[j] = False
            parent[j] = by[j] if best[j] >= self.least_information else -1
            closer = left & (information[j] > best)
            best[closer], by[closer] = information[j][closer], j
        return parent

    def _conditional(self, together: np.ndarray, alone: np.ndarray, rate: np.ndarray) -> np.ndarray:
        """P(vote v of voter j | vote u of the voter it depends on) at [u, v, j], drawn to P(v) by some votes' strength."""
        k = rate.shape[1]
        own = np.arange(k)
        pa = np.where(self.parent < 0, own, self.parent)
        both = together[:, pa, :, own].transpose(1, 2, 0)
        given = (both + self.strength * rate[None]) / (alone[:, pa][:, None, :] + self.strength)
        return np.where(self.parent[None, None, :] < 0, rate[None], given)

    def posterior(self, votes: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        """Every vote counts given the vote of the voter it depends on, abstentions too; labels count if given."""
        own = np.arange(votes.shape[1])
        pa = np.where(self.parent < 0, own, self.parent)
        weigh = np.log(self.given[1]) - np.log(self.given[0])
        said = weigh[votes[:, pa] + 1, votes + 1, own[None, :]]
        score = math.log(self.prior / (1 - self.prior)) + said.sum(axis=1)
        if gold is not None:
            score = score + np.where(gold == 1, 1, -1) * math.log(self.annotator / (1 - self.annotator))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method."""
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ ((p - y)) + ridge * beta
        hess = (x * (np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class ToxicityModel:
    terms: list[str]
    beta: np.ndarray
    label_model: LabelModel | None
    config: ToxicityConfig

    def scorer(self):
        matcher = Matcher(self.terms)
        n = len(self.terms)

        def score(text: str | None) -> float:
            hits, m = describe(text, matcher)
            return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(hits, m, n) @ self.beta))))))

        return score


def _training_rows(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """(text, toxic) of at most ``max_positive`` and ``max_negative`` labelled rows outside the held-out third."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id", 3, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("__at", F.xxhash64(F.lit(17), "doc_id"))
    some = known.where("toxic = 1").orderBy("__at").limit(cfg.max_positive).unionByName(known.where("toxic = 0").orderBy("__at").limit(cfg.max_negative))
    # the sample's size is bounded by the two parameters, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id", "toxic")), "doc_id").select("text", "toxic").distinct()


def _mine(sample: DataFrame, cfg: ToxicityConfig) -> list[str]:
    """Terms that speak for toxicity, the most frequent first; of terms with nearly the same rows the most telling one."""
    lengths, most = cfg.prefix_lengths, len(cfg.min_precision)

    def counting(keep: frozenset[str] | None):
        def make():
            def work(rows: list[dict]) -> list[dict]:
                n: Counter[str] = Counter()
                for r in rows:
                    t = _terms(r["text"], lengths, most)
                    n.update(t if keep is None else t & keep)
                return [{"term": t, "n": c} for t, c in n.items()]

            return work

        return make

    def counted(rows: DataFrame, keep: frozenset[str] | None) -> DataFrame:
        return map_arrow(rows.select("text"), counting(keep), "term string, n long", rows=1024).groupBy("term").agg(F.sum("n").alias("n"))

    least = max(cfg.min_support, cfg.min_share * sample.where("toxic = 1").count())
    top = counted(sample.where("toxic = 1"), None).where(F.col("n") >= least).collect()
    yes = {r["term"]: r["n"] for r in top}
    no = {r["term"]: r["n"] for r in counted(sample.where("toxic = 0"), frozenset(yes)).collect()} if yes else {}
    good = {t: c for t, c in yes.items() if c / (c + no.get(t, 0)) >= cfg.min_precision[int(t[0]) - 1]}
    kept: list[str] = []
    bodies: list[str] = []
    for t in sorted(good, key=lambda t: (-good[t], len(t), t)):
        k, body = t[:2], t[2:]
        if any(body.lstrip("=").startswith(b) for b in bodies):
            continue
        same = [o for o in good if o[:2] == k and o[2:].lstrip("=").startswith(body.lstrip("=")) and good[o] >= 0.98 * good[t]]
        best = max(same, key=lambda o: (len(o), o))
        kept.append(best)
        bodies.append(best[2:].lstrip("=")) if best[2] != "=" else None
        if len(kept) >= cfg.max_voters:
            break
    return list(dict.fromkeys(kept))


def train_toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit voters, label model and linear classifier; see the module for edge cases."""
    sample = durable(_training_rows(docs, labels, cfg))
    terms = _mine(sample, cfg)
    terms += [f"1:={w}" for w in SEED_WORDS if f"1:={w}" not in terms]
    n = len(terms)

    def make():
        matcher = Matcher(terms)

        def work(rows: list[dict]) -> list[dict]:
            out = []
            for r in rows:
                hits, m = describe(r["text"], matcher)
                out.append({"toxic": int(r["toxic"]), "hits": hits, "measures": m})
            return out

        return work

    got = map_arrow(sample, make, "toxic int, hits array<int>, measures array<double>").collect()
    if not any(r["toxic"] for r in got):
        beta = np.zeros(n + 8)
        beta[n:] = (-4.0, 4.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0)
        return ToxicityModel(terms, beta, None, cfg)
    gold = np.array([r["toxic"] for r in got])
    votes = np.array([_votes(r["hits"], r["measures"], n) for r in got])
    x = np.array([features(r["hits"], r["measures"], n) for r in got])
    model = LabelModel()
    posterior = model.fit(votes, gold)
    return ToxicityModel(terms, fit_linear(x, posterior, cfg.l2), model, cfg)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text."""
    threshold = model.config.threshold

    def make():
        score = model.scorer()

        def work(rows: list[dict]) -> list[dict]:
            out = []
            for r in rows:
                s = score(r["text"])
                out.append({"doc_id": r["doc_id"], "held_out": r["held_out"], "score": s, "predicted": int(s >= threshold)})
            return out

        return work

    rows = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    return map_arrow(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""
    threshold = model.config.threshold
    schema = docs.schema
    names = docs.columns

    def run(batches):
        score = model.scorer()
        for batch in batches:
            texts = batch.column(names.index("text"))
            keep = []
            for start in range(0, batch.num_rows, 256):
                keep += [score(t) < threshold for t in texts.slice(start, 256).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
