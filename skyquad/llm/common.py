"""Helpers shared by the operators: reading tables, cutting lineage, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, stash

__all__ = ["drop_marked", "new_folder", "stash", "table", "text_digest", "whole_row", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as the operators read it: null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_digest(column: str = "text") -> Column:
    """SHA-256 of the whole text in UTF-8."""
    return F.unhex(F.sha2(F.encode(whole_text(column), "UTF-8"), 256))


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that none of their names can clash with a working column."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def drop_marked(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text are in ``gone``; of the rows that share a
    doc_id and text in ``repeated`` one stays. Both tables: doc_id and digest (of the text).

    The rows are shuffled once by doc_id and digest, however few the keys are: what a run on little
    data costs is what a large one does.
    """
    gone, repeated = stash(gone.distinct(), "gone"), stash(repeated, "repeated")
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))

    def same(keys: DataFrame):
        return rows["doc_id"].eqNullSafe(keys["doc_id"]) & (rows["digest"] == keys["digest"])

    gone, repeated = gone.hint("merge"), repeated.hint("merge")
    out = rows.join(gone, same(gone), "left_anti")
    if not repeated.isEmpty():
        rows = out
        once = out.join(repeated, same(repeated), "left_anti")
        out = once.unionByName(out.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "digest"]))
    return out.select("row.*")
