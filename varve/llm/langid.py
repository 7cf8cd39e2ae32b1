"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with training texts up to a fixed size.
Case is folded and runs of anything but letters become one space, in dictionaries and texts. A text is
cut into pieces of bounded size - all of them count, so that a dictionary keeps its say however long
the text is - and each piece is compressed with every dictionary, by zstandard's fast strategy, which
leaves literals as they are: so the size tells how much of a piece its dictionary has. The language
whose compressed sizes add up to the least wins; the margin to the runner-up gives the score, and
narrow margins are marked in ``rejected``.

Training reads a bounded sample: of each of the ``max_languages`` most frequent languages at most
``docs_per_language`` distinct documents, by a hash of doc_id and text, and of each a piece of at most
``max_chars`` characters from a place that the hash gives. So languages with none but long documents are
learned too, and rows that repeat a doc_id, or lack it, are sampled like others.

Edge cases: a null text, or one without any letter, gets ``und`` with score 0; a null lang is not learned
from; ties go to the language with the most training rows, then to the one that sorts first; without anything to learn from all rows get ``und``.
A null doc_id counts as the empty text for the split. Repeated rows get equal predictions.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_arrow


NOT_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class LangIdConfig:
    """``max_languages``, ``docs_per_language`` and ``max_chars`` bound the training sample."""

    max_languages: int = 200
    docs_per_language: int = 600
    max_chars: int = 6000
    dictionary_bytes: int = 128 << 10
    piece: int = 512
    min_match: int = 5
    reject_margin: float = 0.02


@dataclass
class LangIdModel:
    """Raw dictionary contents by language, in the order of ties; the compressors are made in each worker."""

    contents: dict[str, bytes]
    config: LangIdConfig

    def classifier(self):
        cfg = self.config
        langs = list(self.contents)
        machines = []
        for content in self.contents.values():
            p = zstandard.ZstdCompressionParameters.from_level(1, source_size=cfg.piece, dict_size=len(content), strategy=zstandard.STRATEGY_FAST, min_match=cfg.min_match, target_length=1, write_content_size=0, write_checksum=0, write_dict_id=0)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            machines.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))

        def classify(text: str | None) -> tuple[str, float, bool]:
            if not langs or not text or not any(map(str.isalpha, text)):
                return "und", 0.0, True
            data = folded(text)
            pieces = [data[i : i + cfg.piece] for i in range(0, len(data), cfg.piece)]
            sizes = [sum([len(m.compress(p)) for p in pieces]) for m in machines]
            order = sorted(range(len(langs)), key=lambda k: (sizes[k], k))
            best = sizes[order[0]]
            margin = 1.0 if len(order) == 1 else (sizes[order[1]] - best) / max(1, sizes[order[1]])
            return langs[order[0]], min(1.0, 0.5 + 2.5 * margin), margin < cfg.reject_margin

        return classify


def train_language_id(docs: DataFrame, cfg: LangIdConfig = LangIdConfig()) -> LangIdModel:
    """Fill the dictionaries from a bounded, hash-chosen sample of the rows that are not held out."""
    known = docs.where("lang is not null and text != ''").where(~held_out("doc_id", 4, 2)).select("lang", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("place"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(cfg.max_languages).collect()}
    if not counts:
        return LangIdModel({}, cfg)
    # twice the wanted share of the hash space first, so that few rows move; then the bound itself
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * cfg.docs_per_language / n))])
    some = known.where(F.pmod("place", F.lit(1 << 20)) / float(1 << 20) < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)))
    start = 1 + F.pmod(F.shiftrightunsigned("place", 20), F.greatest(F.lit(1), F.length("text") - cfg.max_chars + 1))
    pieces = some.select("lang", "place", F.col("text").substr(start.cast("int"), F.lit(cfg.max_chars)).alias("text")).distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 20)), "place", "text")
    rows = pieces.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cfg.docs_per_language).collect()
    contents = {}
    for lang in sorted(counts, key=lambda g: (-counts[g], g)):
        texts = sorted((folded(r["text"]) for r in rows if r["lang"] == lang), key=lambda t: hashlib.md5(t).digest())
        if texts:
            contents[lang] = b" ".join(texts)[: cfg.dictionary_bytes]
    return LangIdModel(contents, cfg)


def identify_language(docs: DataFrame, model: LangIdModel) -> DataFrame:
    """Predict the language of every whole text."""

    def make():
        classify = model.classifier()

        def work(rows: list[dict]) -> list[dict]:
            out = []
            for r in rows:
                lang, score, rejected = classify(r["text"])
                out.append({"doc_id": r["doc_id"], "held_out": r["held_out"], "lang_pred": lang, "score": score, "rejected": rejected})
            return out

        return work

    rows = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text")
    return map_arrow(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
