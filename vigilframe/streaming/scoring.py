"""Scoring of a stream in small groups; what fails in one group leaves the others alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import bands

GROUP = 32  # rows scored together
GroupScorer = Callable[[np.ndarray], Sequence[float]]
SCORES = "seq bigint, score double, label string, error string"


def heuristic(vectors: np.ndarray) -> np.ndarray:
    """tanh of the mean feature value, used when no model is loaded."""
    return np.tanh(vectors.sum(axis=1) / (vectors.shape[1] + 1e-6))


def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    """Features as numbers; a missing one is 0, one that is no number an error."""
    columns = [[0.0 if v is None else float(v) for v in c.to_pylist()] for c in batch.columns[1:]]
    return np.array(columns, float).T.reshape(batch.num_rows, len(columns))


def scored_in_groups(rows: DataFrame, features: Sequence[str], scorer: GroupScorer = heuristic, group: int = GROUP) -> DataFrame:
    """seq, score, label and error of each row, scored with at most `group` - 1 neighbours.

    Rows of a group whose scoring fails get score 0, the label error and the message. Works on
    batch and streaming frames; nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, errors = [], []
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                try:
                    found = [float(s) for s in scorer(vectors_of(part))]
                    if len(found) != part.num_rows:
                        raise ValueError(f"{len(found)} scores for {part.num_rows} rows")
                    scores += found
                    errors += [None] * part.num_rows
                except Exception as exc:  # the group's rows carry the message
                    scores += [0.0] * part.num_rows
                    errors += [str(exc)] * part.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(errors, pa.string())], names=["seq", "score", "error"])

    out = rows.select("seq", *features).mapInArrow(run, "seq bigint, score double, error string")
    label = F.when(F.col("error").isNotNull(), "error").otherwise(bands.anomaly_label(F.col("score")))
    return out.select("seq", "score", label.alias("label"), "error")
