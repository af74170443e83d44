"""Packing documents into sequences: first-fit decreasing on a tournament tree of capacities.

A document's ids (and the end id) are cut into full sequences and one rest. Only the sizes of
the pieces are shuffled: every piece goes to one of many groups by a hash of its id, start, checksum
and row, so rows without an id or with one id spread too, and each group packs its rests by itself, longest first, into the first sequence with enough room.
A tournament tree over the sequences' free room finds that sequence in logarithmic time.
"""

from __future__ import annotations

import zlib
from array import array

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.tokens import chunk_tokens
from vigilframe.llm.words import settle

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
CUT = PIECES + ", row long"
PLACED = PIECES + ", sequence_id long, offset long"
GROUP_BITS = 31  # sequence_id = group * 2^31 + number in the group


class Tournament:
    """Leaves hold the free room of the sequences; an inner node holds its children's maximum."""

    def __init__(self, leaves: int, room: int):
        self.size = 1 << max(0, (leaves - 1).bit_length())
        self.tree = [room] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """Takes `need` from the first leaf that has it; (leaf, its room before)."""
        tree, node = self.tree, 1
        while node < self.size:
            node *= 2
            if tree[node] < need:
                node += 1
        leaf, before = node - self.size, tree[node]
        tree[node] = before - need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return leaf, before


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the given order; a length is at most `capacity`."""
    tree = Tournament(max(1, len(lengths)), capacity)
    return [(b, capacity - room) for b, room in (tree.place(n) for n in lengths)]


def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of every document, with the checksum of its ids; nothing is shuffled."""
    end = array("I", [end_id]).tobytes()

    def cut(batches):
        ids, row = chunk_tokens(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = ids.text(text or "") + end
                total = len(data) // 4
                for start in range(0, total, capacity):
                    piece = data[4 * start : 4 * (start + capacity)]
                    out.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, row))
                row += 1
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return docs.select("doc_id", "text").mapInArrow(cut, CUT)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, group_docs: int = 4096) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Null or empty text: the end id alone. Null ids and repeated rows are packed like any other
    row, each on its own. Ties in length go by doc_id and start. An empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    pieces = settle(cut_pieces(docs, path, capacity, end_id))
    groups = max(1, -(-pieces.where("start = 0").count() // group_docs))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "order", "start"], ascending=[False, True, True], kind="stable")
        spots = first_fit(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = [(key[0] << GROUP_BITS) + b for b, _ in spots]
        pdf["offset"] = [o for _, o in spots]
        pdf["doc_id"] = pd.array([int(d) if d is not None else None for d in pdf["doc_id"]], "Int64")
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # The pieces are settled, so a repeated task sees the same row numbers.
    group = F.pmod(F.xxhash64("order", "start", "ids_crc32", "row", F.lit("pack")), F.lit(groups)).alias("group")
    # pandas makes floats of a nullable long column, which can't hold ids beyond 2^53: the id goes as text.
    rows = pieces.withColumn("order", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.groupBy(group).applyInPandas(place, PLACED)
