"""Rank fusion, score normalisation and ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(dense: DataFrame, lexical: DataFrame, k: int, alpha: float = 0.5, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (qid, rank, id) lists: alpha / (c + dense rank) + (1 - alpha) / (c + lexical rank).

    An id that one list lacks has nothing from it. Larger alpha favours the dense list; alpha 0 is allowed.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    both = dense.select("qid", "id", (alpha / (constant + F.col("rank"))).alias("s")).unionByName(lexical.select("qid", "id", ((1 - alpha) / (constant + F.col("rank"))).alias("s")))
    fused = both.groupBy("qid", "id").agg(F.sum("s").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "id")
    return fused.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "rank", "id", "score")


def min_max(hits: DataFrame) -> DataFrame:
    """hits with norm, the score between its query's lowest (0) and highest (1); 0.5 where all are equal."""
    w = Window.partitionBy("qid")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", F.when(hi == lo, F.lit(0.5)).otherwise((F.col("score") - lo) / (hi - lo)))


def evaluate_ranking(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """One row of (qid, id) truth against (qid, rank, id) hits: top3, top5, mrr and both denominators.

    Rows of truth without a usable query or id stay in the accuracies' denominator and not in the reciprocal rank's.
    """
    usable = truth.withColumn("usable", F.col("qid").isNotNull() & F.col("id").isNotNull())
    met = usable.join(hits.select("qid", "id", "rank"), ["qid", "id"], "left")
    return met.agg(
        F.count("*").alias("n"),
        F.count_if("usable").alias("n_usable"),
        F.avg(F.coalesce(F.col("rank") <= 3, F.lit(False)).cast("int")).alias("top3"),
        F.avg(F.coalesce(F.col("rank") <= 5, F.lit(False)).cast("int")).alias("top5"),
        F.avg(F.when(F.col("usable"), F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))).alias("mrr"),
    )


def with_contents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits with the contents of their documents, in rank order; ids without a document are dropped, scores stay with ids."""
    return hits.join(docs.select("id", "contents"), "id")


def passages(hits: DataFrame, title_of, text_of) -> DataFrame:
    """A text block a query: `Doc i (Title: ...)` and the text, by rank."""
    block = F.concat(F.lit("Doc "), F.col("rank").cast("string"), F.lit(" (Title: "), title_of(F.col("contents")), F.lit(")\n"), text_of(F.col("contents")), F.lit("\n"))
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return rows.select("qid", F.array_join(F.transform("bs", lambda x: x["b"]), "").alias("passages"))
