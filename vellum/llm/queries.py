"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, charset, lookalike, mainbody, markup, mixing, repetition, site_lines


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.found_lines(table(spark, sf_dir, "web_articles"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "web_articles")
    return site_lines.without_lines(articles, site_lines.found_lines(articles))


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.block_report(table(spark, sf_dir, "web_articles"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.repaired_runs(table(spark, sf_dir, "text_runs")).select("run_id")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.repaired_runs(table(spark, sf_dir, "text_runs")).select("run_id", "restored", "complete")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.residue_articles(table(spark, sf_dir, "web_articles"))


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "web_articles")
    return articles.join(mainbody.residue_articles(articles), "article_id", "left_anti").select("article_id", "url", "title")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.cut_verdicts(table(spark, sf_dir, "web_articles")).where("is_cut").select("article_id")


def p4_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.truncation_report(table(spark, sf_dir, "web_articles"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.equal_looking_pairs(table(spark, sf_dir, "text_runs"), table(spark, sf_dir, "web_articles"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = lookalike.canonical_forms(table(spark, sf_dir, "text_runs"), table(spark, sf_dir, "web_articles"))
    return forms.select("record_kind", "id", "form").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.with_markup(table(spark, sf_dir, "text_runs"), table(spark, sf_dir, "web_articles"))


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_places(table(spark, sf_dir, "web_articles"))


def p6_clean_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_runs(table(spark, sf_dir, "text_runs"))


def p6_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_pages(table(spark, sf_dir, "web_articles"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.page_lines(table(spark, sf_dir, "web_articles"))


def p7_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "web_articles")
    return site_lines.without_lines(articles, mainbody.page_lines(articles))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.document_ids(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.actual_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p9_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.margins(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf_dir, "documents"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeated_shares(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}
