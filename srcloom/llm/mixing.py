"""Sources mixed to target shares of all tokens.

Every document draws a hash-random key.  Keys are uniform, so cutting their range
into equal buckets range-partitions each source evenly without sampling, a hot source
into as many buckets as its size asks for.  Token sums per bucket give distributed
prefix sums; each source is cut at its exact budget, whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents a key bucket holds on average.
BUCKET_DOCS = 50_000
SEED = 17


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per listed source: available tokens, budget in tokens, whole epochs and the rest.

    Without total_tokens the total is the largest one at which every source that has
    tokens can fill its share within max_repeats.  A source without tokens reaches
    nothing; the others' shares are scaled to sum to one.  With total_tokens a source that
    is too small gives all it may.
    """
    t = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    b = t.join(F.broadcast(sizes), "source", "left").withColumn("available", F.coalesce("tokens", F.lit(0))).withColumn("n_docs", F.coalesce("docs", F.lit(0))).drop("tokens", "docs")
    # One row per listed source: the windows without a partition see the fixed target list only.
    every = Window.partitionBy(F.lit(0))
    live = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))
    b = b.withColumn("share", F.coalesce(live, F.lit(0.0)) / F.sum(live).over(every))
    cap = F.col("available") * F.col("max_repeats")
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.min(F.when(F.col("share") > 0, cap / F.col("share"))).over(every)
    b = b.withColumn("total", total).withColumn("budget", F.least(cap, F.floor(F.coalesce(F.col("total") * F.col("share"), F.lit(0.0)) + 1e-6)).cast("long"))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)).cast("long")
    return b.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of a mixture of docs (doc_id, source, n_tokens).

    selection has doc_id, source, n_tokens, repeats (uses of the whole document) and
    tokens_used: repeats * n_tokens, and for the one document at the cut of its source
    the tokens of its first part as well, so that a source meets its budget exactly.
    Sources that are null or not listed and documents without tokens are not drawn.
    report has one row per listed source.  Ties of the key are settled by doc_id.
    docs is read twice and should be a written table.
    """
    listed = F.broadcast(targets.where("source IS NOT NULL").select("source").distinct())  # bounded by the target list
    d = docs.select("doc_id", "source", "n_tokens").where("n_tokens > 0").join(listed, "source", "left_semi")
    sizes = d.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    b = budgets(sizes, targets, total_tokens)
    plan = F.broadcast(b.select("source", "epochs", "rest", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_DOCS)).alias("buckets")))  # one row per listed source
    h = F.xxhash64(F.lit(seed), "doc_id", "source")
    keyed = d.withColumn("key", h).join(plan, "source").withColumn("bucket", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("buckets")))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = sums.withColumn("before", F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.join(before.select("source", "bucket", "before"), ["source", "bucket"])
    ahead = F.coalesce(F.col("before"), F.lit(0)) + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))
    run = run.withColumn("ahead", ahead)
    partial = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("ahead")))
    chosen = run.withColumn("last", partial).select(
        "doc_id", "source", "n_tokens", (F.col("epochs") + F.when(F.col("last") == F.col("n_tokens"), 1).otherwise(0)).cast("long").alias("repeats"),
        (F.col("epochs") * F.col("n_tokens") + F.col("last")).cast("long").alias("tokens_used"),
    ).where("tokens_used > 0")
    used = chosen.groupBy("source").agg(F.sum("tokens_used").alias("used"), F.count(F.lit(1)).alias("docs_used"), F.max("repeats").alias("most_repeats"))
    every = Window.partitionBy(F.lit(0))
    report = b.join(F.broadcast(used), "source", "left").select(
        "source", "target_share", "max_repeats", "n_docs", F.col("available").cast("long").alias("available_tokens"), F.col("budget").alias("budget_tokens"),
        F.coalesce("used", F.lit(0)).cast("long").alias("used_tokens"), F.coalesce("docs_used", F.lit(0)).cast("long").alias("docs_used"), F.coalesce("most_repeats", F.lit(0)).cast("long").alias("whole_repeats"),
        F.coalesce(F.round(F.coalesce("used", F.lit(0)) / F.sum(F.coalesce("used", F.lit(0))).over(every), 6), F.lit(0.0)).alias("actual_share"),
    )
    return chosen, report
