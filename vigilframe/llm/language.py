"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language and bucket give a matrix of log probabilities of fixed size (languages by
buckets), which is broadcast. Texts are scored in batches: the rows of a batch's n-grams are
taken from the matrix and summed per text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import PART, counter_rows, packed, scatter, slices, summed_counts, unpacked

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
CHUNK = 1 << 18  # code points scored together
SPACE = np.uint64(32)
FEW = 10_000  # languages whose row counts are sent to all tasks
OUT = "lang_pred string, score double"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text: lower case, every run of other characters one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    points = np.where(is_letter, points, SPACE)
    points = points[is_letter | np.concatenate([[True], is_letter[:-1]])]
    points = np.concatenate([[SPACE], points, [SPACE]])
    out, h = [], np.zeros(len(points), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        h = (h[: len(points) - order + 1] << np.uint64(21)) | points[order - 1 :]
        if order in ORDERS:
            out.append(scatter(h * np.uint64(2 * order + 1)) & np.uint64(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    weights: np.ndarray  # buckets x languages

    def scores(self, texts: list[str | None]):
        """(language, confidence) per text; the posterior is tempered by the root of the length."""
        at = 0
        while at < len(texts):
            found, lengths, total = [], [], 0
            while at < len(texts) and (total == 0 or total < CHUNK):
                ids = grams(texts[at]) if texts[at] and self.langs else np.empty(0, np.int64)
                found.append(ids)
                lengths.append(len(ids))
                total += len(ids)
                at += 1
            lengths = np.array(lengths)
            full = np.flatnonzero(lengths)
            starts = np.cumsum(lengths[full]) - lengths[full]
            if len(full):
                sums = np.add.reduceat(self.weights[np.concatenate(found)], starts, axis=0, dtype=np.float64)
                logits = (self.prior + sums) / np.sqrt(lengths[full])[:, None]
                odds = np.exp(logits - logits.max(axis=1, keepdims=True))
                odds /= odds.sum(axis=1, keepdims=True)
                best = odds.argmax(axis=1)
            answers = [(UNKNOWN, 0.0)] * len(lengths)
            for i, row in enumerate(full.tolist()):
                answers[row] = (self.langs[best[i]], float(odds[i, best[i]]))
            yield from answers


def learnt(docs: DataFrame, per_lang: int = 4000, smoothing: float = 0.1) -> Model:
    """A model from the text and non-null lang of docs.

    The fit takes about `per_lang` documents of each language, chosen by a hash of the text, so
    its cost doesn't grow with the corpus; the texts taken are read whole.
    """
    docs = docs.where("lang is not null and text is not null").select("lang", "text")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("of"))
    if sizes.count() <= FEW:  # else adaptive execution picks the join
        sizes = F.broadcast(sizes)
    mark = F.xxhash64("text", F.lit("lang"))
    picked = docs.join(sizes, "lang").where(F.pmod(mark, F.col("of")) < per_lang)

    def count(batches):
        tables, rows, pid = {}, {}, TaskContext.get().partitionId()
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
                table += np.bincount(grams(text), minlength=BUCKETS)
                rows[lang] = rows.get(lang, 0) + 1
        out = list(counter_rows(pid, tables))
        out += [{"key": k, "part": -1, "pid": pid, "counts": packed(np.array([n]))} for k, n in rows.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["key"] for r in out], pa.string()), pa.array([r["part"] for r in out], pa.int32()),
             pa.array([r["pid"] for r in out], pa.int64()), pa.array([r["counts"] for r in out], pa.binary())],
            names=["key", "part", "pid", "counts"])

    counted = picked.mapInArrow(count, "key string, part int, pid long, counts binary")
    tables, rows = {}, {}
    for r in summed_counts(counted, ["key", "part"]).collect():  # languages x buckets numbers
        piece = unpacked(r["counts"])
        if r["part"] < 0:
            rows[r["key"]] = int(piece[0])
        else:
            tables.setdefault(r["key"], np.zeros(BUCKETS, np.int64))[r["part"] * PART : r["part"] * PART + len(piece)] = piece
    langs = sorted(tables)
    if not langs:
        return Model([], np.empty(0), np.empty((BUCKETS, 0), np.float32))
    counts = np.stack([tables[k] for k in langs], axis=1) + smoothing
    share = np.array([rows[k] for k in langs], float)
    return Model(langs, np.log(share / share.sum()), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def predicted(text: Column, model: Model, spark) -> Column:
    """struct(lang_pred, score) of a text column; null, or no letter: 'und' and 0."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(OUT)
    def guess(column: pa.Array) -> pa.Array:
        answers = [a for part in slices([column]) for a in sent.value.scores(part.to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([a for a, _ in answers], pa.string()), pa.array([b for _, b in answers], pa.float64())],
            names=["lang_pred", "score"])

    return guess.asNondeterministic()(text)  # else a filter on the result would run it twice


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves that remainder; null ids are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row. Repeated rows and null ids are like others; an
    empty table gives no rows. Without a learnt language everything is 'und'."""
    return docs.select("doc_id", predicted(F.col("text"), model, docs.sparkSession).alias("p")).select("doc_id", "p.lang_pred", "p.score")
