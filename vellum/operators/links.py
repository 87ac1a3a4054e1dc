"""The list of links to clip: ingest, deduplication, upsert, order, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls


def ingest(texts: DataFrame, existing: DataFrame, text: str = "text") -> DataFrame:
    """``url``: sanitised URLs found in texts that are not among the existing ones yet."""
    found = texts.select(F.explode(urls.found_urls(F.col(text))).alias("u")).select(urls.sanitized(F.col("u")).alias("url"))
    return found.where(F.trim("url") != "").distinct().join(existing.select("url"), "url", "left_anti")


def latest(links: DataFrame) -> DataFrame:
    """The last state of each link; of equal times the last status by name, repeated rows count once.

    ``max_by`` combines before the shuffle, so a link with very many rows costs one row per task.
    """
    state = F.struct("url", "domain", "status", "error", "article_id", "updated_at")
    rank = F.struct("updated_at", "status", F.coalesce("error", F.lit("")), F.coalesce("article_id", F.lit(-1)))
    return links.groupBy("link_id").agg(F.max_by(state, rank).alias("s")).select("link_id", "s.*")


def upsert(links: DataFrame, clipped: DataFrame) -> DataFrame:
    """Links with clipped pages put in place of those of equal url, after the others."""
    kept = links.join(clipped.select("url").distinct(), "url", "left_anti").withColumn("batch", F.lit(0))
    return kept.unionByName(clipped.withColumn("batch", F.lit(1)), allowMissingColumns=True)


def moved(links: DataFrame, link_id: int, delta: int, order: str = "ord", partition: str = "batch") -> DataFrame:
    """Order after moving one link by ``delta`` places; a move beyond the ends changes nothing."""
    w = W.partitionBy(partition)
    n = F.count(F.lit(1)).over(w)
    at = F.max(F.when(F.col("link_id") == link_id, F.col(order))).over(w)
    to = at + delta
    ok = at.isNotNull() & (to >= 0) & (to < n)
    place = (
        F.when(~F.coalesce(ok, F.lit(False)), F.col(order))
        .when(F.col(order) == at, to)
        .when((F.col(order) > at) & (F.col(order) <= to), F.col(order) - 1)
        .when((F.col(order) < at) & (F.col(order) >= to), F.col(order) + 1)
        .otherwise(F.col(order))
    )
    return links.withColumn("new_ord", place.cast("int"))


def status_summary(links: DataFrame) -> DataFrame:
    """Links per domain and status; links without a domain get it from their url."""
    name = F.coalesce("domain", urls.domain(F.col("url")))
    return links.groupBy(name.alias("domain"), "status").agg(F.count(F.lit(1)).alias("n_links"), F.count("error").alias("n_with_error"))
