"""How five filters interact: what every order of them removes, and at which step.

A document is known by the set of filters it fails (a mask), so only counts per part and mask
are needed. In an order of the filters a document falls at the first one of its mask. The
orders in lexicographic rank that start with the same letters are neighbours: those in which a
mask falls at step s by one prefix form an interval of (5 - s)! ranks. Its count is added at
the interval's start and taken off after its end; one prefix sum over the 120 ranks then gives
the removals of all orders.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import byte_texts

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10  # words; per cent of words; per cent of characters
OUT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
       "good_lost long, toxic_lost long, shapley long")


def text_mask(text: bytes, points: int) -> int:
    """The filters A to D that a text fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        BIT["A"] * (len(words) < LEAST_WORDS)
        | BIT["B"] * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
        | BIT["C"] * (100 * capitals > MOST_CAPITALS * points)
        | BIT["D"] * (len(text.translate(None, MARKS)) < len(text))
    )


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, same, mask): `same` is a 128-bit digest of the text; mask holds A to D."""

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            points = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            texts = byte_texts(column)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                 pa.array([text_mask(t, n) for t, n in zip(texts, points)], pa.int32())],
                names=["doc_id", "part", "same", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, same binary, mask int")


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and part fail just these filters.

    The holder of a text's smallest id is found by a map-side minimum; it is looked up by text
    and id together, so that a text with many copies is no hot key.
    """
    rows = text_masks(docs).groupBy("doc_id", "same", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    repeat = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (
        rows.join(first, ["same", "doc_id"], "left")
        .withColumn("mask", F.col("mask").bitwiseOR(F.when(repeat, F.lit(BIT["E"])).otherwise(F.lit(0))))
        .groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    )


@lru_cache(maxsize=1)
def orders() -> list[str]:
    """All orders of the filters, by lexicographic rank."""
    return ["".join(p) for p in permutations(FILTERS)]


def lehmer_rank(prefix: str) -> int:
    """Rank of the first order that starts with the prefix."""
    rest, rank = list(FILTERS), 0
    for letter in prefix:
        at = rest.index(letter)
        rank += at * factorial(len(rest) - 1)
        rest.pop(at)
    return rank


@lru_cache(maxsize=1)
def intervals() -> tuple[np.ndarray, ...]:
    """(mask, step from 0, first rank, rank after the last) of all prefixes at which a mask falls."""
    out = []
    for step in range(len(FILTERS)):
        width = factorial(len(FILTERS) - 1 - step)
        for prefix in permutations(FILTERS, step + 1):
            start, passed = lehmer_rank("".join(prefix)), sum(BIT[f] for f in prefix[:-1])
            out += [(m, step, start, start + width) for m in range(1 << len(FILTERS)) if m & BIT[prefix[-1]] and not m & passed]
    return tuple(np.array(c) for c in zip(*out))


def removals(counts: np.ndarray) -> np.ndarray:
    """Removed at (step, rank), from counts per mask."""
    mask, step, start, end = intervals()
    steps = np.zeros((len(FILTERS), len(orders()) + 1), np.int64)
    np.add.at(steps, (step, start), counts[mask])
    np.subtract.at(steps, (step, end), counts[mask])
    return steps.cumsum(axis=1)[:, :-1]


def audit_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one part from its at most 32 masks."""
    size = 1 << len(FILTERS)
    counts = {c: np.zeros(size, np.int64) for c in ("n", "good", "toxic")}
    for c, held in counts.items():
        np.add.at(held, pdf["mask"].to_numpy(), pdf[c].to_numpy())
    lost = {c: removals(held) for c, held in counts.items()}
    letters = np.array([[FILTERS.index(f) for f in o] for o in orders()]).T  # filter at (step, rank)
    n, all_masks = counts["n"], np.arange(size)
    fails = np.array([n[(all_masks & BIT[f]) > 0].sum() for f in FILTERS])
    alone = np.array([n[BIT[f]] for f in FILTERS])
    worth = np.zeros(len(FILTERS), np.int64)
    np.add.at(worth, letters, lost["n"])
    ranks, steps = len(orders()), len(FILTERS)
    flat = lambda a: a.T.reshape(-1)
    return pd.DataFrame({
        "part": pdf["part"].iloc[0], "filter_order": np.repeat(orders(), steps),
        "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), ranks),
        "kept": flat(n.sum() - lost["n"].cumsum(axis=0)), "removed": flat(lost["n"]),
        "redundant": flat(fails[letters] - lost["n"]), "unique_fails": flat(alone[letters]),
        "good_lost": flat(lost["good"]), "toxic_lost": flat(lost["toxic"]), "shapley": flat(worth[letters]),
    })


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (lang; null is the empty string), order of the filters and step what the step does.

    Filters: A under 100 words, B fewer distinct words than 80 % of the words, C over 10 %
    capitals A-Z, D any of # $ % & * |, E a text that a smaller id has too. Null text is empty:
    it fails A, and E if a smaller id has an empty text. A row without an id never fails E, makes
    no other row fail it, and has no labels. Rows that repeat an id count each; with equal texts
    none makes the other fail E. A document is good (toxic) if any of its label rows says so.
    An empty table gives no rows. Other columns are not read.
    """
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    held = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    counts = masks(docs).join(marked, "doc_id", "left").groupBy("part", "mask").agg(
        held("quality").alias("good"), held("toxic").alias("toxic_n"), F.sum("n").alias("n"))
    return counts.withColumnRenamed("toxic_n", "toxic").groupBy("part").applyInPandas(audit_part, OUT)
