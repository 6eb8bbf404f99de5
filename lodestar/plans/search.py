"""The search interface: one call for dense, lexical and hybrid top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import fusion, lexical, vector

KINDS = ("dense", "bm25", "hybrid")


def search(queries: DataFrame, k: int = 3, kind: str = "dense", alpha: float = 0.5, vectors: DataFrame | None = None, index: lexical.LexicalIndex | None = None) -> DataFrame:
    """(qid, text and / or embedding) -> qid, rank, id, score.

    dense needs vectors (id, embedding), bm25 an index, hybrid both; alpha weighs the dense list, 0 to 1.
    """
    if kind not in KINDS:
        raise ValueError(f"no such search: {kind}; there are {', '.join(KINDS)}")
    if kind == "hybrid" and not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    dense = lambda: vector.knn_join(queries.select("qid", "embedding"), vectors, k)
    words = lambda: lexical.bm25(queries.select("qid", "text"), index, k).withColumnRenamed("doc_id", "id")
    if kind == "dense":
        return dense()
    return words() if kind == "bm25" else fusion.rrf(dense(), words(), k, alpha)
