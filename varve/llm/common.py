"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder is used, but only if the session runs in one machine
    (a ``local`` master); on a cluster without the setting this raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="varve-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def durable(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a way that outlives any executor, and it makes a result that is used
    several times be computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/varve-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[list[dict]], list[dict]]], schema: str, rows: int = 256) -> DataFrame:
    """Run ``make()`` once in each Python worker and the function it returns on slices of at most ``rows`` rows.

    Slices keep the Python objects of a batch few, however long its texts are.
    """
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                if work is None:
                    work = make()
                made = work(batch.slice(start, rows).to_pylist())
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=out)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def held_out(column: str, modulus: int, remainder: int):
    """True where crc32(column as text) mod ``modulus`` is ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def input_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by whatever path Spark can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


