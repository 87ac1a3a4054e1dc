"""Problem 9: a mix of sources by target shares of tokens.

Token totals are gathered per cell of source, language and form of text.  Iterative proportional fitting
rakes the cells' weights until the mix meets the target shares of the sources and, as far as those allow,
keeps the proportions that languages and forms have among the sources that take part.  A weight is how
often a document of its cell is to be used on average, so it never exceeds the source's max_repeats; the
total is the largest at which every source can reach its share.  Documents are then drawn by their
calibrated weights: the whole part as often as it says, the rest by systematic sampling along the order
of token counts, which keeps the drawn tokens close to the calibrated ones.

The largest total at which every source reaches its share is bound by one source, which the report names.
With ``total_tokens`` a mix of that size is made instead: sources that can't fill their share of it give all
they may, fall short, and the report shows it.

Documents of other sources and of no source take no part, nor do null, empty and blank texts, which have
no tokens to give.  A language that is null or unknown is a class of its own; codes are compared without
case and region.  Sources with a target that have no tokens, or that may not be used at all (``max_repeats`` null, zero or
less), get nothing and the others keep their shares among themselves.  Repeated rows of a doc_id count as documents of their own.  Empty tables give empty results.

Cells are at most sources x LANGUAGES x forms, so they may be collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import with_ids

#: Languages that keep a class of their own, the rest is one class.
LANGUAGES = 32
SWEEPS = 200
#: Documents of a source that are drawn together: a larger source is drawn in parts, each in its own task.
PART_DOCS = 200_000


def sized(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, source, lang, form, n_tokens`` of the documents that take part."""
    wanted = targets.select("source").where("source is not null").distinct()  # one row per wanted source
    lang = F.coalesce(F.nullif(F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]+)", 1)), F.lit("")), F.lit("und"))
    form = (
        F.when(F.col("text").rlike(r"^\s*#|\n\s*(?:[-*>|]|#+) "), "notes")
        .when(F.col("text").rlike(r"(?:^|\n)[^\n:：]{1,16}[:：] "), "dialogue")
        .when(F.col("text").rlike(r"(?:^|\n)\s*(?:Chapter \d|第.{1,6}[章回节])"), "chapters")
        .otherwise("prose")
    )
    docs = documents.where("text is not null and source is not null").join(wanted, "source", "left_semi")
    docs = docs.select("doc_id", F.struct("source", lang.alias("lang"), form.alias("form")).alias("cell"), "text")
    # the cell travels with the row as one key, so counting needs no join
    counted = with_ids(
        docs.select(F.to_json(F.struct("doc_id", "cell.*")).alias("key"), "text"), "key", "string", tokenizer, count_only=True
    )
    parsed = F.from_json("key", "doc_id long, source string, lang string, form string").alias("k")
    return counted.select(parsed, "n_tokens").select("k.*", "n_tokens").where("n_tokens > 0")


def usable(targets: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    """Targets of the sources that may be used at all."""
    return {s: (share, most) for s, (share, most) in targets.items() if share > 0 and most > 0}


def raked(
    cells: list[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]], total_tokens: float | None = None
) -> dict[tuple[str, str, str], float]:
    """Weight of each cell (source, language, form): mean uses of its documents.

    Without ``total_tokens`` all shares are met, at the largest total that allows it; with it sources that
    can't fill their share of that total are used up and fall short.
    """
    targets = usable(targets)
    cells = [c for c in cells if c[0] in targets and c[3] > 0]
    if not cells:
        return {}
    tokens = np.array([c[3] for c in cells], dtype=float)
    cap = np.array([targets[c[0]][1] for c in cells], dtype=float)
    axes = []
    for axis in range(3):
        names = sorted({c[axis] for c in cells})
        place = {name: i for i, name in enumerate(names)}
        axes.append((np.array([place[c[axis]] for c in cells]), names))
    src, sources = axes[0]
    share = np.array([targets[s][0] for s in sources])
    share = share / share.sum()
    have = np.bincount(src, weights=tokens, minlength=len(sources))
    caps = np.array([targets[s][1] for s in sources], dtype=float)
    total = float((caps * have / share).min()) if total_tokens is None else float(total_tokens)
    wanted = np.minimum(share * total, caps * have)
    goals = [wanted]
    for at, names in axes[1:]:
        part = np.bincount(at, weights=tokens, minlength=len(names))
        goals.append(part / part.sum() * wanted.sum())
    weight = (wanted / have)[src]
    for _ in range(SWEEPS):
        before = weight.copy()
        for (at, names), goal in zip(reversed(axes), reversed(goals)):  # sources last: their shares bind
            got = np.bincount(at, weights=weight * tokens, minlength=len(names))
            weight = weight * (goal / np.maximum(got, 1e-9))[at]
            if at is src:
                # what the cap takes from a cell goes to the other cells of its source
                for _ in range(8):
                    weight = np.minimum(weight, cap)
                    lack = np.maximum(goal - np.bincount(src, weights=weight * tokens, minlength=len(sources)), 0)
                    room = np.bincount(src, weights=(cap - weight) * tokens, minlength=len(sources))
                    weight = weight + (cap - weight) * np.minimum(1, lack / np.maximum(room, 1e-9))[src]
        if np.abs(weight - before).max() < 1e-9:
            break
    return {c[:3]: float(min(w, k)) for c, w, k in zip(cells, weight, cap)}


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 1, total_tokens: float | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, repeats`` of every document that the mix uses."""
    return drawn(cut_lineage(sized(documents, targets)), targets, seed, total_tokens).select("doc_id", "source", "n_tokens", "repeats").where("repeats > 0")


def drawn(docs: DataFrame, targets: DataFrame, seed: int = 1, total_tokens: float | None = None) -> DataFrame:
    """The documents of sized() with ``weight``, the mean uses of their cell, and ``repeats``, their own."""
    spark = docs.sparkSession
    common = docs.groupBy("lang").agg(F.sum("n_tokens").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    kept = [r["lang"] for r in common.collect()]  # at most LANGUAGES
    docs = docs.withColumn("lang", F.when(F.col("lang").isin(kept), F.col("lang")).otherwise("other")) if kept else docs
    cells = docs.groupBy("source", "lang", "form").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    parts: dict[str, int] = {}
    for r in cells:
        parts[r["source"]] = parts.get(r["source"], PART_DOCS - 1) + r["docs"]
    goals = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.dropDuplicates(["source"]).collect()}
    weights = raked([tuple(r)[:4] for r in cells], goals, total_tokens)
    table = spark.createDataFrame(
        [(*k, weights.get(k, 0.0), parts[k[0]] // PART_DOCS) for k in (tuple(r)[:3] for r in cells)],
        "source string, lang string, form string, weight double, parts int",
    )
    weighed = docs.join(F.broadcast(table), ["source", "lang", "form"], )  # one row per cell
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("parts"))
    order = W.partitionBy("source", "part").orderBy("n_tokens", F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    rest = F.col("weight") - F.floor("weight")
    run = F.sum(rest).over(order.rowsBetween(W.unboundedPreceding, 0))
    # parts begin at different offsets, so that what they round off evens out
    offset = (F.col("part") + 0.5) / F.col("parts")
    placed = weighed.withColumn("part", part).withColumn("run", run)
    extra = F.floor(F.col("run") + offset) - F.floor(F.col("run") - rest + offset)
    repeats = (F.floor("weight") + extra).cast("int")
    return placed.withColumn("repeats", repeats)


def actual_shares(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per source: wanted and actual share of tokens, documents used, largest number of repeats, and whether the
    source is at its cap and so bounds the mix."""
    every = cut_lineage(drawn(cut_lineage(sized(documents, targets)), targets, total_tokens=total_tokens))
    used = F.col("n_tokens") * F.col("repeats")
    by = every.groupBy("source").agg(
        F.sum(used).alias("tokens"), F.count_if(F.col("repeats") > 0).alias("n_docs"), F.max("repeats").alias("most_repeats"),
        (F.sum(F.col("n_tokens") * F.col("weight")) / F.sum("n_tokens")).alias("mean_uses"),
    )
    whole = by.agg(F.sum("tokens").alias("all_tokens"))
    zero = F.lit(0)
    return (
        targets.join(by, "source", "left").crossJoin(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", F.coalesce(F.try_divide(F.coalesce("tokens", zero), F.col("all_tokens")), F.lit(0.0)).alias("actual_share"),
            F.coalesce("tokens", zero).alias("tokens"), F.coalesce("n_docs", zero).alias("n_docs"),
            F.coalesce("most_repeats", zero).alias("most_repeats"), "max_repeats",
            F.coalesce(F.col("mean_uses") >= F.col("max_repeats") * (1 - 1e-6), F.lit(False)).alias("at_cap"),
        )
    )


def margins(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """``axis, value, wanted_share, actual_share`` of languages and forms: what they have among the sources that
    may be used, and what they have in the mix."""
    docs = cut_lineage(sized(documents, targets))
    every = cut_lineage(drawn(docs, targets, total_tokens=total_tokens))
    part = every.join(F.broadcast(targets.where("max_repeats > 0 and target_share > 0").select("source").distinct()), "source", "left_semi")  # one row per wanted source
    each = part.select(F.explode(F.array(F.struct(F.lit("lang").alias("axis"), F.col("lang").alias("value")), F.struct(F.lit("form").alias("axis"), F.col("form").alias("value")))).alias("m"), "n_tokens", "repeats")
    sums = each.groupBy("m.axis", "m.value").agg(F.sum("n_tokens").alias("have"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used"))
    axis = W.partitionBy("axis")  # two rows of sums, at most LANGUAGES values each
    return sums.select(
        "axis", "value", (F.col("have") / F.sum("have").over(axis)).alias("wanted_share"), F.coalesce(F.try_divide(F.col("used"), F.sum("used").over(axis)), F.lit(0.0)).alias("actual_share")
    )
