"""Document boundaries in flat token files that have no index.

A file is a run of token ids in which an end id follows each document. Files are read in blocks
of fixed size; each block is searched for the end id in one vector operation. A document may
span blocks: a prefix scan over per-block counts carries the number of documents and the place
of the last separator into each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.tokens import chunk_tokens
from vigilframe.llm.words import settle

BLOCK = 1 << 16  # tokens
LANE = 1024  # blocks scanned in one window
SHARD = 1024  # documents of consecutive ids in a file
FAR = 1 << 62  # files of rows without an id and pieces of crowded files; no id div SHARD comes near
FEW = 10_000  # crowded files that are sent to all tasks


def with_file(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(file, doc_id, text): file is doc_id div shard, rows without an id have one of their own.

    A file that would hold more than 4 * shard documents, as ids repeat or are missing, is cut by a
    hash of the text into pieces of about `shard`, which are files with numbers from 2^62 on. Rows equal
    in id and text share a file.
    """
    doc = F.col("doc_id").cast("long")
    docs = docs.select(F.floor(doc / shard).cast("long").alias("range"), doc.alias("doc_id"), "text")
    crowded = settle(docs.groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > 4 * shard).select(
        F.col("range").alias("crowd"), F.ceil(F.col("n") / shard).alias("pieces")))
    n, far = crowded.count(), F.lit(FAR)
    own = F.coalesce("range", far)
    if not n:
        return docs.select(own.alias("file"), "doc_id", "text")
    rows = docs.join(F.broadcast(crowded) if n <= FEW else crowded, F.col("range").eqNullSafe(F.col("crowd")), "left")
    # Pieces whose hashes agree are one file.
    piece = far + F.pmod(F.xxhash64("range", F.pmod(F.xxhash64("text"), F.col("pieces"))), far)
    return rows.select(F.when(F.col("pieces").isNull(), own).otherwise(piece).alias("file"), "doc_id", "text")


def token_files(docs: DataFrame, path: str, end_id: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The blocks (see blocks_of_files) of the files that with_file makes from documents."""
    return blocks_of_files(with_file(docs, shard), path, end_id, block)


def blocks_of_files(placed: DataFrame, path: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of flat 16-bit token files made from (file, doc_id, text).

    In a file documents follow each other by doc_id (of one id by length of text, then text). The block
    holds `block` ids, the last one of a file the rest.
    """
    if end_id >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    mark = np.array([end_id], "<u2").tobytes()

    def encode(batches):
        ids = chunk_tokens(path)
        for batch in batches:
            data = [np.frombuffer(ids.text(t or ""), "<u4").astype("<u2").tobytes() + mark for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["file", "doc_id", "data"])

    def cut(batches):
        file, number, held = None, 0, b""
        step = 2 * block
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != file:
                    if held:
                        out.append((file, number, held))
                    file, number, held = name, 0, b""
                held += data
                while len(held) >= step:
                    out.append((file, number, held[:step]))
                    number, held = number + 1, held[step:]
            yield blocks_of(out)
        yield blocks_of([(file, number, held)] if held else [])

    def blocks_of(rows):
        columns = list(zip(*rows)) or [[]] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["file", "block", "data"])

    encoded = placed.select("file", "doc_id", "text").mapInArrow(encode, "file long, doc_id long, data binary")
    return encoded.repartition("file").sortWithinPartitions("file", "doc_id", F.length("data"), "data").mapInArrow(
        cut, "file long, block long, data binary")


def block_counts(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, block, n_tokens, spots): where each block has the end id."""

    def scan(batches):
        for batch in batches:
            ids = [np.frombuffer(d or b"", "<u2") for d in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([np.flatnonzero(i == end_id) for i in ids], pa.list_(pa.int64()))], names=["file", "block", "n_tokens", "spots"])

    return blocks.select("file", "block", "data").mapInArrow(scan, "file long, block long, n_tokens long, spots array<long>")


def documents_in(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, doc_index, start, n_tokens, closed) of each document of the files, end id excluded.

    blocks: file, block (0, 1, ... in each file), data (16-bit ids). Ids after a file's last
    separator are a document that is not closed. A document of no ids is one with n_tokens 0.
    An empty block or table adds none; null data is an empty block.
    """
    found = settle(block_counts(blocks, end_id)).withColumn("lane", F.floor(F.col("block") / LANE))
    last = F.element_at(F.when(F.size("spots") > 0, F.col("spots")), -1)
    sums = [F.sum("n_tokens").alias("n"), F.sum(F.size("spots")).cast("long").alias("d")]
    lanes = found.groupBy("file", "lane").agg(*sums)
    earlier = Window.partitionBy("file").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("file", "lane", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"lane_{c}") for c in ("n", "d")])
    inside = Window.partitionBy("file", "lane").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.join(lanes, ["file", "lane"]).withColumns({
        "base": F.col("lane_n") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)),
        "docs": F.col("lane_d") + F.coalesce(F.sum(F.size("spots")).over(inside), F.lit(0))})
    rows = rows.withColumn("last", F.col("base") + last)
    # The last separator before a block: in its lane, or the last of an earlier lane.
    tails = rows.groupBy("file", "lane").agg(F.max("last").alias("tail"))
    tails = tails.select("file", "lane", F.max("tail").over(earlier).alias("far"))
    rows = rows.join(tails, ["file", "lane"]).withColumn("from", F.coalesce(F.max("last").over(inside), F.col("far"), F.lit(-1)) + 1)
    ends = F.transform("spots", lambda s: s + F.col("base"))
    spans = F.transform(ends, lambda e, i: F.struct(
        (F.col("docs") + i).alias("doc_index"), F.coalesce(F.get(ends, i - 1) + 1, F.col("from")).alias("start"), e.alias("end")))
    closed = rows.select("file", F.inline(spans)).select(
        "file", "doc_index", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    files = rows.groupBy("file").agg(
        F.max(F.col("base") + F.col("n_tokens")).alias("n"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"),
        F.sum(F.size("spots")).cast("long").alias("doc_index"))
    rest = files.where("n > start").select("file", "doc_index", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)
