"""Mixing sources to target weights with hash-threshold histograms.

Every text has a hash. A source's share is the texts below a hash threshold: tokens are summed by source and hash bucket, the
bucket in which the source's budget ends is found, and only that bucket is split into finer ones, until it holds a single text
or the hash has no bits left. The selection is then a filter by threshold; nothing is sorted or ranked, and a larger budget
selects a superset of a smaller one's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import materialize

#: Bits of the hash by which one level of the histogram splits, and levels: 48 bits in all.
BITS, LEVELS = 12, 4


def source_name(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, blanks and - as _."""
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]+", "_")


def distinct_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, h): each text once, under its smallest doc_id. Copies of a text, in whichever source, are one text,
    so that it cannot be used more often under another id. Texts without tokens are left out.

    documents: doc_id, source, text_key, n_tokens."""
    best = F.min(F.struct("doc_id", "source", "n_tokens"))
    once = documents.where("n_tokens > 0 and text_key is not null").groupBy("text_key").agg(best.alias("b"))
    return once.select("b.doc_id", source_name(F.col("b.source")).alias("source"), "b.n_tokens", F.shiftrightunsigned(F.xxhash64("text_key"), 64 - BITS * LEVELS).alias("h"))


def source_budgets(texts: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, passes, rest): how many tokens each listed source has and shall give.

    Without a total, the largest is taken at which every listed source that has texts reaches its share within its repeats. A source
    gives `passes` whole passes over its texts and `rest` tokens more. All rows are those of the targets table, not of the data.
    """
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    t = t.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    if total is None:
        reach = F.when((F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("available") * F.col("max_repeats") / F.col("target_share"))
        t = t.withColumn("total", F.min(reach).over(Window.partitionBy(F.lit(1))))
    else:
        t = t.withColumn("total", F.lit(float(total)))
    most = F.col("available") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    budget = F.least(F.round(F.coalesce(F.col("target_share") * F.col("total"), F.lit(0.0))).cast("long"), most)
    t = t.withColumn("budget", budget).withColumn("passes", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("long"))
    return t.withColumn("rest", F.col("budget") - F.col("passes") * F.col("available")).drop("total")


def thresholds(texts: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): the texts of a source with h below it hold as nearly as possible `rest` tokens: the text in which these end is
    taken if that is nearer (more than half of it fits).

    Each level sums tokens over the boundary bucket of the level before only; its result has at most 2**BITS rows per source of the
    targets table, so it is the targets that bound what is joined, never the data.
    """
    low = F.lit(0).cast("long")
    state = materialize(budgets.where("rest > 0").select("source", low.alias("low"), F.col("rest").alias("left")), "thresholds")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = texts.join(F.broadcast(state), "source").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(1 << (shift + BITS))))
        sums = inside.groupBy("source", F.shiftrightunsigned("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("t"))
        running = Window.partitionBy("source").orderBy("bucket")
        fits = F.col("upto") <= F.col("left") if level < LEVELS - 1 else 2 * F.col("upto") - F.col("t") < 2 * F.col("left")
        upto = sums.join(F.broadcast(state), "source").withColumn("upto", F.sum("t").over(running)).where(fits)
        taken = upto.groupBy("source").agg(F.max("upto").alias("taken"), F.max("bucket").alias("bucket"))
        edge = F.when(F.col("bucket").isNull(), F.col("low")).otherwise(F.shiftleft(F.col("bucket") + 1, shift))
        state = materialize(state.join(taken, "source", "left").select("source", edge.alias("low"), (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left")), "thresholds")
    return state.select("source", F.col("low").alias("threshold"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the selected texts and how often each is used, at most max_repeats times.

    documents: doc_id, source, text_key, n_tokens (text_key: equal for equal texts). Unlisted sources, and listed ones with a null or
    non-positive number of repeats, give nothing. Empty tables give an empty result.
    """
    texts = materialize(distinct_texts(documents), "texts")
    budgets = materialize(source_budgets(texts, targets, total), "budgets")
    cut = thresholds(texts, budgets)
    plan = budgets.select("source", "passes").join(cut, "source", "left")
    repeats = F.col("passes") + F.when(F.col("h") < F.coalesce("threshold", F.lit(0)), 1).otherwise(0)
    return texts.join(F.broadcast(plan), "source").withColumn("repeats", repeats).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def share_report(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: texts, tokens, largest number of repeats, and the share of all selected tokens beside the target."""
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    got = selected.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats")
    )
    rows = t.join(got, "source", "left").fillna(0, ["n_texts", "n_tokens", "most_repeats"])
    whole = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("share", F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0))
