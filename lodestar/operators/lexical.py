"""Lexical search: an inverted index as plain tables, BM25 ranking by equi-joins.

The formula is exact BM25 over a documented regex tokenizer: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 0.9, b = 0.4 by
default; no stemming, no stop words and no quantised lengths, so scores differ from engines that have these.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import written

BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows it to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@dataclass
class LexicalIndex:
    postings: DataFrame  # term, doc_id, tf, len
    terms: DataFrame  # term, df
    corpus: DataFrame  # one row: n, avgdl

    def save(self, path: str) -> None:
        for name in ("postings", "terms", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "corpus")))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """Postings, term and corpus statistics; documents without text are left out.

    The postings are written in the shared folder, so that texts are cut into terms once whatever is asked of the index; the terms'
    and the corpus's statistics are made from them.
    """
    present = docs.filter(F.length(text_col) > 0)
    toks = present.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("t")).withColumn("len", F.size("t"))
    postings = written(toks.select("doc_id", "len", F.explode("t").alias("term")).groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf")), "postings")
    terms = written(postings.groupBy("term").agg(F.count("*").alias("df")), "terms")
    held = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("held"))
    corpus = written(present.agg(F.count("*").alias("n")).join(F.broadcast(held), F.lit(True)).select("n", F.try_divide("held", "n").alias("avgdl")), "corpus-size")  # one row each
    return LexicalIndex(postings, terms, corpus)


def index_rows(docs: DataFrame, id_col: str, columns: tuple[str, ...] = ("contents", "text", "body")) -> DataFrame:
    """id and contents of documents: the first of the columns that is there and not blank; rows without any go."""
    own = [F.when(F.length(F.trim(c)) > 0, F.col(c)) for c in columns if c in docs.columns]
    return docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(*own, F.lit(None).cast("string")).alias("contents")).filter("contents IS NOT NULL")


def bm25(queries: DataFrame, index: LexicalIndex, k: int, k1: float = 0.9, b: float = 0.4, most_tf: int | None = None, boost: Sequence[str] = (), factor: float = 1.2) -> DataFrame:
    """(qid, text) -> qid, rank, doc_id, score: each query's k best documents. A query's repeated terms count once.

    most_tf caps term frequencies; boosted terms weigh `factor` times as much.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    weighed = small(asked.join(index.terms, "term"))
    tf = F.least("tf", F.lit(most_tf)) if most_tf else F.col("tf")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    if boost:
        part = part * F.when(F.col("term").isin(list(boost)), factor).otherwise(1.0)
    n, avgdl = (index.corpus.select(c).scalar() for c in ("n", "avgdl"))
    hits = index.postings.join(weighed, "term").withColumn("n", n).withColumn("avgdl", avgdl)
    scored = hits.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def holders(passages: DataFrame, index: LexicalIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: int = 5) -> DataFrame:
    """(qid, text) -> qid, doc_id: every document whose text contains the passage as it stands.

    A passage's terms but its first and last, which may be parts of longer words, are terms of any text that contains it. Documents
    that have the rarest of them are candidates, whose texts are then searched; passages of fewer than three terms meet every text.
    """
    t = tokens("text")
    asked = passages.select("qid", "text", F.array_distinct(F.slice(t, F.lit(2), F.greatest(F.size(t) - 2, F.lit(0)))).alias("inner"))
    found = asked.select("qid", "text", F.explode("inner").alias("term")).join(index.terms, "term", "left")
    order = Window.partitionBy("qid", "text").orderBy(F.coalesce("df", F.lit(0)), "term")
    picked = found.withColumn("r_", F.row_number().over(order)).filter(F.col("r_") <= rarest).select("qid", "text", "term")
    need = picked.groupBy("qid", "text").agg(F.count("*").alias("need_"))
    met = index.postings.select("term", "doc_id").join(small(picked), "term").groupBy("qid", "text", "doc_id").agg(F.count("*").alias("n_"))
    candidates = written(met.join(small(need), ["qid", "text"]).filter("n_ >= need_").select("qid", "doc_id", F.col("text").alias("passage_")), "candidates")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("whole_"))
    holds = F.contains("whole_", F.col("passage_"))
    short = small(asked.filter(F.size("inner") == 0).select("qid", F.col("text").alias("passage_")))
    return texts.join(small(candidates), "doc_id").filter(holds).select("qid", "doc_id").unionByName(texts.join(short, holds).select("qid", "doc_id"))


def weights(index: LexicalIndex, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """The index as sparse vectors: doc_id, term, weight."""
    n, avgdl = (index.corpus.select(c).scalar() for c in ("n", "avgdl"))
    rows = index.postings.join(index.terms, "term").withColumn("n", n).withColumn("avgdl", avgdl)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return rows.select("doc_id", "term", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))).alias("weight"))
