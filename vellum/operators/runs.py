"""Styled runs of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STYLE = ("bold", "italic", "font_size", "color", "strikethrough")


def merged(runs: DataFrame) -> DataFrame:
    """``doc_id, block_index, seg, text, <style>``: neighbouring runs of equal style as one.

    Repeated rows count once and empty runs are left out.  A run begins a segment where its style differs
    from the one before; null equals null.  Windows and grouping share the partitioning by block.
    """
    clean = runs.where("text is not null and text <> ''").dropDuplicates(["run_id"])
    w = W.partitionBy("doc_id", "block_index").orderBy("run_index", "run_id")
    same = F.lit(True)
    for c in STYLE:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    begins = F.when(F.row_number().over(w) == 1, 0).when(same, 0).otherwise(1)
    numbered = clean.withColumn("begins", begins).withColumn("seg", F.sum("begins").over(w))
    parts = F.sort_array(F.collect_list(F.struct("run_index", "run_id", "text")))
    return numbered.groupBy("doc_id", "block_index", "seg", *STYLE).agg(parts.alias("parts")).select(
        "doc_id", "block_index", "seg", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), *STYLE
    )
