"""Labelled rows for training: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulo.llm.common import stable


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def _some(rows: DataFrame, seed: int, share: float) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * share))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, y``: documents with a label for which ``learn`` (over doc_id) holds; about ``most`` of them, chosen by their ids' hash.

    One row an id: null labels are dropped, of several labels the highest holds, of several texts the one whose hash is
    least. The ids are broadcast, being of bounded number; the sample is kept in the shared folder, as it is read more than once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > most:
        known = _some(known, 3, most / n)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.max("y").alias("y"))
    return stable(one.select("doc_id", "t.text", "y"))


def within(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """``rows`` (with ``doc_id``), or so many of them that ``size`` sums to about ``most``: none above a hundredth of it, the others by their ids' hash."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total <= most:
        return rows
    small = rows.where(size <= max(most // 100, 1))
    total = small.agg(F.sum(size)).first()[0] or 0
    return _some(small, 4, most / total) if total > most else small
