"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range.

Sketches made with one fraction can be merged, and containment between very unequal documents
can be read from them. A document with fewer than `least` such hashes raises its own threshold
until it holds `least` of them (or all), so that short texts can be compared too. Two sketches
are compared below the lower of their thresholds, where both are whole.

A fingerprint is the threshold (16 hex digits), a colon, and the sorted hashes in base64.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import byte_texts, shingle_set, word_hashes, word_memo

TOP = (1 << 64) - 1
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, contained_edited double, contained_next double")


def sketch(hashes: np.ndarray, fraction: int, least: int) -> tuple[int, np.ndarray]:
    """(threshold, kept hashes) of sorted distinct shingle hashes; kept are those <= threshold."""
    limit = TOP // fraction
    if len(hashes) <= least:
        return TOP, hashes
    below = int(np.searchsorted(hashes, np.uint64(limit), "right"))
    if below < least:
        below, limit = least, int(hashes[least - 1])
    return limit, hashes[:below]


def to_text(threshold: int, kept: np.ndarray) -> str:
    return f"{threshold:016x}:" + base64.b64encode(kept.astype(">u8").tobytes()).decode()


def from_text(fingerprint: str) -> tuple[int, np.ndarray]:
    head, _, body = fingerprint.partition(":")
    return int(head, 16), np.frombuffer(base64.b64decode(body), ">u8").astype(np.uint64)


def merged(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of both documents' shingles together."""
    limit = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return limit, both[both <= np.uint64(limit)]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[float, float | None]:
    """Estimates of the Jaccard likeness and of a's containment in b.

    Two documents without words are alike (1, 1); one without words is unlike any other (0, 0).
    The containment of a text of which no hash lies below the common threshold is unknown (None).
    At a fraction of 1/16 that befalls a text of n shingles with a chance of (15/16)^n: 0.28 for 20,
    0.002 for 100.
    """
    limit = np.uint64(min(a[0], b[0]))
    x = a[1][: np.searchsorted(a[1], limit, "right")]
    y = b[1][: np.searchsorted(b[1], limit, "right")]
    if len(x) == 0 or len(y) == 0:
        if len(x) < len(a[1]) and len(x) == 0:
            return 0.0, None
        same = float(len(x) == len(y))
        return same, same
    at = np.searchsorted(y, x)
    both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
    return both / (len(x) + len(y) - both), both / len(x)


def with_next(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, int]:
    """(doc_id, text, mark, bucket, copy) and the number of buckets, so that in each bucket, ordered by descending doc_id and
    then by mark with the copies last, a row's next document is the row after it.

    Ids are cut into buckets at their quantiles. An id that fills several quantiles, and the rows
    without an id, which come last, are cut further by the mark, a hash of the text. The first
    documents of a bucket are copied to the end of the bucket before it (those of the very first one
    to the last bucket). Buckets are numbered from 0 in order. Rows equal in id and text aren't cut.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts, rows, ids = docs.agg(
        F.percentile_approx("doc_id", quantiles, max(10_000, 20 * buckets)), F.count("*"), F.count("doc_id")).head()
    cuts = Counter(cuts or [0])
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="__at", outputCol="__range", handleInvalid="keep")
    share = (F.col("mark") / F.lit(2.0**64)) + 0.5  # 0 to 1
    # The pieces of ids with several quantiles lie between the larger and the smaller ids of their range.
    piece = F.when(F.col("doc_id").isNull(), F.floor(share * max(1, -(-(rows - ids) * buckets // max(1, rows)))))
    for hot, n in sorted((c, n) for c, n in cuts.items() if n > 1):
        piece = piece.when(F.col("doc_id") == hot, 1 + F.least(F.floor(share * n), F.lit(n - 1)))
        piece = piece.when((F.col("doc_id") < hot) & (F.col("__at") == float(hot)), n + 1)
    placed = cut.transform(docs.withColumn("__at", F.col("doc_id").cast("double"))).select(
        "doc_id", "text", "mark", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("__range")).cast("int").alias("range"),
        F.coalesce(piece, F.lit(0)).cast("int").alias("piece"))
    # One row for each bucket: at most three for each quantile and those of null ids.
    first = F.min(F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("at"), "mark")).alias("first")
    heads = sorted(placed.groupBy("range", "piece").agg(first).collect(), key=lambda r: (-r["range"], r["piece"]))
    listed = [(r["range"], r["piece"], *r["first"], i, (i - 1) % len(heads)) for i, r in enumerate(heads)]
    targets = spark.createDataFrame(listed, "range int, piece int, head_at long, head_mark long, bucket int, target int")
    own = F.struct(F.col("bucket"), F.lit(False).alias("copy"))
    halo = F.struct(F.col("target").alias("bucket"), F.lit(True).alias("copy"))
    is_head = (F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)) == F.col("head_at")) & (F.col("mark") == F.col("head_mark"))
    rows = (
        placed.join(F.broadcast(targets), ["range", "piece"])
        .select("doc_id", "text", "mark", F.explode(F.when(is_head, F.array(own, halo)).otherwise(F.array(own))).alias("p"))
        .select("doc_id", "text", "mark", "p.bucket", "p.copy")
    )
    return rows, len(heads)


def fingerprints(docs: DataFrame, width: int = 5, fraction: int = 16, least: int = 32) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    contained_edited and contained_next are null where nothing of the text can be compared (likeness).
    Edited: the last third of the code points gives way to the next document's first ones. Null
    text is empty; rows that repeat an id follow each other by a hash of the text; null ids come last.
    A single document is its own next one. An empty table gives no rows. Other columns are not read.
    """
    placed, buckets = with_next(docs)
    rows = (
        placed.repartitionById(max(1, buckets), "bucket")  # one task for each bucket
        .sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), "mark", F.col("text").asc_nulls_first())
        .drop("mark")
    )

    def run(batches):
        memo, held = word_memo(), None

        def mark(text: bytes):
            return sketch(shingle_set(word_hashes(text, memo), width), fraction, least)

        def row(this, after):
            doc, text, own = this
            n = len(text)
            taken = after[1][: n // 3]
            edited = (text[: n - n // 3] + taken).encode()
            other = mark(edited)
            near, part = likeness(own, other)
            near_next, part_next = likeness(own, after[2])
            return (doc, n, hashlib.sha256(edited).hexdigest(), to_text(*own), to_text(*other), near, near_next, part, part_next)

        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.float64()] * 4
        for batch in batches:
            out = []
            columns = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), byte_texts(batch.column(1)))
            for doc, bucket, copy, data in columns:
                this = (doc, data.decode(), mark(data))
                if held and held[0] == bucket:
                    out.append(row(held[1], this))
                held = None if copy else (bucket, this)
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.mapInArrow(run, RESULT)
