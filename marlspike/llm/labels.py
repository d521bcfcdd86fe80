"""A bounded, documented sample of labelled rows for fitting classifiers, and score calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the identifier's decimal text, modulo; 0 < null identifiers give null."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) of at most `per_class` rows of each label value, lowest identifier hashes first.

    Null labels and identifiers are left out; a document labelled twice counts once, with its highest label. The
    chosen identifiers (2 x per_class at most) are broadcast, so documents are filtered where they are read.
    """
    known = labels.where(train & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")
    picked = rows.groupBy("id").agg(F.min("t").alias("t"), F.first("y").alias("y")).orderBy(F.xxhash64("id"), "id")
    return [(r.t, int(r.y)) for r in picked.select("t", "y").toLocalIterator()]


def squash(raw: np.ndarray, threshold: float, scale: float, at: float = 0.3) -> np.ndarray:
    """Scores from 0 to 1, monotone in `raw`, with `at` at the threshold."""
    return 1 / (1 + np.exp(-np.clip((raw - threshold) * scale + np.log(at / (1 - at)), -40, 40)))
