"""Document fingerprints: a digest of bucket quartiles.

A window of four bytes slides over the UTF-8 bytes of a text. Each window gives three byte triplets
(its last byte with two of the bytes before it), each hashed with its own salt to one of 128 buckets.
The bucket counts are encoded by their quartile (two bits a bucket), after a header with the byte
length's logarithm and the ratios of the quartiles. Two digests are compared by a bounded score: the
sum of quartile distances (a jump over two quartiles costs extra) and of header distances, scaled to
a likeness from 0 to 1.

The digest of a text depends on nothing but its bytes, so equal texts have equal fingerprints.

Edge cases: a null text is the empty text; a text of fewer than four bytes is padded with zero bytes
and so has a digest too; rows that share a doc_id are ordered by a hash of their text and then by the
text; rows with a null doc_id come last; a table of one row is its own next document; of an empty
table the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, durable

BUCKETS = 128
#: Two bits for each bucket at most; a jump over two or three quartiles costs 3 or 6.
STEP = np.array([0, 1, 3, 6], dtype=np.int64)
WORST = 6 * BUCKETS


def _hash(a: np.ndarray, b: np.ndarray, c: np.ndarray, salt: int) -> np.ndarray:
    """Bucket of each byte triplet: a multiplicative hash of the three bytes."""
    x = (a << np.uint32(16)) | (b << np.uint32(8)) | c
    x = (x + np.uint32(salt)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x >> np.uint32(25)


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit, block by block, so that memory is bounded for any length."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if len(data) < 4:
        data = data + b"\0" * (4 - len(data))
    block = 1 << 20
    for start in range(0, len(data) - 3, block):
        u = np.frombuffer(data, dtype=np.uint8, count=min(block + 3, len(data) - start), offset=start).astype(np.uint32)
        p, q, r, s = u[:-3], u[1:-2], u[2:-1], u[3:]
        for salt, (x, y) in enumerate(((r, q), (r, p), (q, p)), 1):
            counts += np.bincount(_hash(x, y, s, salt * 0x2545F491), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """Header (length, two quartile ratios) and 128 two-bit codes as 70 hexadecimal digits."""
    counts = bucket_counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = np.packbits(((codes[:, None] >> np.array([1, 0], dtype=np.uint8)) & 1).ravel())
    size = min(255, int(np.log2(len(data) + 1) * 8))
    ratios = (min(15, 16 * q1 // (q3 + 1)) << 4) | min(15, 16 * q2 // (q3 + 1))
    spread = min(255, int(np.log2(q3 + 1) * 8))
    return bytes([size, ratios, spread]).hex() + packed.tobytes().hex()


def _codes(digest: str) -> tuple[bytes, np.ndarray]:
    raw = bytes.fromhex(digest)
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=3)).reshape(-1, 2)
    return raw[:3], (bits[:, 0].astype(np.int64) << 1) | bits[:, 1]


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling with the difference score to 0 at a bound; symmetric."""
    if a == b:
        return 1.0
    (ha, ca), (hb, cb) = _codes(a), _codes(b)
    score = int(STEP[np.abs(ca - cb)].sum())
    score += max(0, abs(ha[0] - hb[0]) - 1) + max(0, abs((ha[1] >> 4) - (hb[1] >> 4)) - 1) + max(0, abs((ha[1] & 15) - (hb[1] & 15)) - 1)
    return max(0.0, 1.0 - min(score, 300) / 300.0)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(doc_id, text: str, own: str, next_text: str, next_print: str) -> dict:
    n = len(text)
    k = n // 3
    edited = text[: n - k] + next_text[:k]
    data = edited.encode("utf-8", "surrogatepass")
    e = fingerprint(data)
    return {"doc_id": doc_id, "n_chars": n, "edited_sha256": hashlib.sha256(data).hexdigest(), "fingerprint": own, "edited_fingerprint": e, "near_edited": likeness(own, e), "near_next": likeness(own, next_print)}


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text, its edited text and compare with the next document in descending doc_id.

    The texts move once: a range partitioning by descending doc_id, then each partition streams through
    Python with one row of look-ahead. The last row of a partition meets the first row of the next
    non-empty one in a small second step, whose rows are as many as the partitions.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("text")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, F.col("doc_id").desc_nulls_last(), F.col("tie")).sortWithinPartitions(*order).select("doc_id", "text")
    schema = f"part int, kind int, text string, {RESULT}"
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                made = []
                for r in batch.slice(start, 256).to_pylist():
                    text = r["text"]
                    own = fingerprint(text.encode("utf-8", "surrogatepass"))
                    if last is None:
                        made.append({"part": part, "kind": 1, "text": text, "fingerprint": own})
                    else:
                        made.append({"part": part, "kind": 0} | _judge(*last, text, own))
                    last = (r["doc_id"], text, own)
                yield pa.RecordBatch.from_pylist(made, schema=out)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "kind": 2, "doc_id": last[0], "text": last[1], "fingerprint": last[2]}], schema=out)

    done = durable(sorted_rows.mapInArrow(run, schema))
    names = [f.split()[0] for f in RESULT.split(", ")]
    heads = done.where("kind = 1").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    # as many rows as partitions: each part's follower, and the first part for the last one
    parts = done.where("kind = 1").select("part")
    follow = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("to"))
    ends = done.where("kind = 2").select("part", "doc_id", "text", "fingerprint").join(follow, "part").join(heads.withColumnRenamed("part", "to"), "to")
    out_last = arrow_schema(spark, RESULT)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_judge(r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_print"]) for r in batch.to_pylist()], schema=out_last)

    return done.where("kind = 0").select(*names).unionByName(ends.mapInArrow(finish, RESULT))
