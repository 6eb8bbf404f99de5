"""Negative sampling and contrastive samples. Random choices are orders by md5 of (id, seed): any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .samples import with_position
from .vector import knn_join


def hash_order(*parts: Column, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def hard_negatives(queries: DataFrame, corpus: DataFrame, top: int = 10, skip: int = 3, n: int = 3, seed: int = 0) -> DataFrame:
    """Of a query's `top` nearest others, the first `skip` left out, n by hash order (all, if fewer): qid, id."""
    near = knn_join(queries, corpus, top + 1, exclude_self=True).filter(F.col("rank") <= top)
    pick = Window.partitionBy("qid").orderBy(hash_order(F.col("qid"), F.col("id"), seed=seed))
    return near.filter(F.col("rank") > skip).withColumn("pick", F.row_number().over(pick)).filter(F.col("pick") <= n).select("qid", "id", "rank", "pick")


def easy_negatives(samples: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    """n distinct contents of other rows for each of (id, contents), all others if they are fewer: id, contents, pick.

    Distinct contents lie on a ring in the order of their hashes; a row takes those from the place that its id's hash names on, its
    own left out. Places are joined by equality: each row meets n + 1 contents, whatever the table's size.
    """
    distinct = samples.select("contents").filter("contents IS NOT NULL").distinct()
    ring = with_position(distinct.withColumn("h_", hash_order(F.col("contents"), seed=seed)), "h_").select(F.col("contents").alias("other"), "position")
    m = ring.count()
    if m == 0:
        return samples.select("id", "contents", F.lit(1).alias("pick")).filter("false")
    start = F.conv(F.substring(hash_order(F.col("id"), seed=seed), 1, 12), 16, 10).cast("long") % m
    asked = samples.select("id", "contents", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(min(n + 1, m) - 1))).alias("step"))
    met = asked.withColumn("position", (F.col("start") + F.col("step")) % m).join(ring, "position").filter(~F.col("other").eqNullSafe(F.col("contents")))
    pick = Window.partitionBy("id").orderBy("step")
    return met.withColumn("pick", F.row_number().over(pick)).filter(F.col("pick") <= n).select("id", F.col("other").alias("contents"), "pick")


def drop_false_negatives(pairs: DataFrame) -> DataFrame:
    """Negatives that score above the positive are taken to be positives."""
    return pairs.filter(F.col("negative_score") <= F.col("positive_score"))


def contrastive(samples: DataFrame, hard: DataFrame, easy: DataFrame, mode: str = "intended") -> DataFrame:
    """Contrastive rows of (id, query, contents): messages, positive and negative messages.

    Negatives are hard then easy, each content once; mode "as_written" takes the easy ones alone.
    """
    gather = lambda df, name: df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", "contents"))), lambda s: s["contents"]).alias(name))
    empty = F.array().cast("array<string>")
    rows = samples.join(gather(hard, "hard"), "id", "left").join(gather(easy, "easy"), "id", "left")
    own = F.coalesce("easy", empty)
    negatives = own if mode == "as_written" else F.array_distinct(F.concat(F.coalesce("hard", empty), own))
    message = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    return rows.select(
        "id",
        F.array(message("user", F.col("query"))).alias("messages"),
        F.array(F.array(message("assistant", F.col("contents")))).alias("positive_messages"),
        F.transform(negatives, lambda x: F.array(message("assistant", x))).alias("negative_messages"),
    )
