"""Settings of a job from a small JSON file, by whatever path Spark can open."""

from __future__ import annotations

import json
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def load(spark: SparkSession, path: str, kind: type[T]) -> T:
    """The settings of ``kind`` that the file holds; names it does not know are an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    strange = set(given) - {f.name for f in fields(kind)}
    if strange:
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(strange))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
