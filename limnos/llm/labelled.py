"""Held-out folds, labelled documents and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.spread import small


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls into ``fold``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def labelled(labels: DataFrame, label_col: str, folds: int, fold: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of every labelled document outside the held-out fold, and the sizes of both classes.

    Null ids and labels other than 0 and 1 teach nothing; an id with several labels counts as 1 if one of them is.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return known, {0: sizes.get(0, 0), 1: sizes.get(1, 0)}


def labelled_sample(labels: DataFrame, label_col: str, folds: int, fold: int, per_class: int, id_col: str = "doc_id",
                    even: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) outside the held-out fold: about ``per_class`` rows of each class by a hash of the id, all where there are fewer,
    and the sizes of both classes before that. ``even``: of the larger class not many more than the smaller one has.
    """
    known, sizes = labelled(labels, label_col, folds, fold, id_col)
    per_class = min(per_class, *sizes.values()) if even and min(sizes.values()) else per_class
    rate = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / max(1, sizes[1])))).otherwise(F.lit(min(1.0, per_class / max(1, sizes[0]))))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < rate * 1_000_000), sizes


def with_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of a bounded sample; the sample is the side that is broadcast, so the texts are not shuffled."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.join(small(sample, sample.count()), "doc_id")
