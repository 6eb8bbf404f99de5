"""Nearest-neighbour joins: exact by matrix products over blocks, and an inverted-file index that prunes by cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 1024  # queries that travel together
BLOCK = 4096  # vectors of the corpus that travel together where the queries are many
TILES, SHARE = 4096, 16384  # queries and vectors of the corpus, of any cluster, that are dealt to one share of each cluster
CELLS = 2**21  # scores held at once


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row indices and columns of each row's k best and of what ties with the k-th, rounded to 9 places."""
    s = np.round(scores, 9)
    edge = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    return np.nonzero(s >= edge[:, None])


def _score(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return q @ c.T
    if metric == "l2":
        return -((q**2).sum(1)[:, None] - 2 * (q @ c.T) + (c**2).sum(1)[None, :])
    raise ValueError(f"no such metric: {metric}")


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", exclude_self: bool = False) -> DataFrame:
    """Each query's k best rows of the corpus: (qid, embedding) x (id, embedding) -> qid, rank, id, score.

    metric ip: highest inner product; l2: smallest squared distance. Scores tie on nine places, ties go to the smaller id. Up
    to TILE queries (counted) travel to the corpus's tasks as one broadcast tile, so that only partial results are
    shuffled; more of them meet blocks of the corpus tile by tile. Null vectors take no part.
    """
    sign = 1.0 if metric == "ip" else -1.0
    queries = queries.filter(F.col("embedding").isNotNull())
    corpus = corpus.filter(F.col("embedding").isNotNull())
    n = queries.count()
    tiles = max(1, -(-n // TILE))
    packed = queries.groupBy(F.expr(f"int(pmod(xxhash64(qid), {tiles}))").alias("tile")).agg(F.collect_list(F.struct("qid", F.col("embedding").cast("array<double>").alias("v"))).alias("qs"))

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), BLOCK):
                part = f.iloc[a : a + BLOCK]
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tolist()], "data": [np.stack(part["embedding"].to_numpy()).astype("<f8").tobytes()]})

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for qs, ids, data in zip(f["qs"], f["ids"], f["data"]):
                qids, q = np.array([x["qid"] for x in qs]), np.stack([np.asarray(x["v"], float) for x in qs])
                ids, c = np.asarray(ids), np.frombuffer(data, "<f8").reshape(-1, q.shape[1])
                s = _score(q, c, metric)
                if exclude_self:
                    s[qids[:, None] == ids[None, :]] = -np.inf
                rows, cols = _top(s, ids, k)
                keep = np.isfinite(s[rows, cols])
                rows, cols = rows[keep], cols[keep]
                yield pd.DataFrame({"qid": qids[rows], "id": ids[cols], "score": s[rows, cols]})

    blocks = corpus.select("id", "embedding").mapInPandas(block, "ids array<long>, data binary")
    if tiles == 1:
        met = blocks.join(F.broadcast(packed.drop("tile")))  # one row
    else:
        met = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).join(packed, "tile")
    found = met.select("qs", "ids", "data").mapInPandas(search, "qid long, id long, score double")
    best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "rank", "id", (F.col("score") * sign).alias("score"))


def train_centroids(corpus: DataFrame, n: int, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """n centroids from at most `sample` vectors, taken by hash of id: a bound, whatever the corpus holds."""
    rows = corpus.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select("embedding").toPandas()
    x = np.stack(rows["embedding"].to_numpy()).astype(float)
    c = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T - (c**2).sum(1) / 2, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].mean(0)
    return c


def assign(rows: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """rows with cluster: one row for each of the `probes` nearest centroids. Null vectors take no part."""
    half = (centroids**2).sum(1) / 2

    def near(v: pd.Series) -> pd.Series:
        s = np.stack(v.to_numpy()).astype(float) @ centroids.T - half
        return pd.Series(list(np.argsort(-s, axis=1)[:, :probes].astype(np.int32)))

    return rows.filter(F.col("embedding").isNotNull()).withColumn("cluster", F.explode(F.pandas_udf(near, "array<int>")("embedding")))


def _packed(rows: DataFrame, deal: str, groups: int, name: str, k: int | None = None) -> DataFrame:
    """(id, embedding, cluster) -> one row a cluster and share by hash of id: the ids in order and their vectors as bytes.

    With k, of a share's equal vectors only the k smallest ids are kept: no other can be among k best.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        x = np.stack(f["embedding"].to_numpy()).astype("<f8")
        if k is not None:
            kept = pd.DataFrame({"v": [v.tobytes() for v in x]}).groupby("v").cumcount().to_numpy() < k
            f, x = f[kept], x[kept]
        return pd.DataFrame({"cluster": [f["cluster"].iloc[0]], deal: [f[deal].iloc[0]], f"{name}_ids": [f["id"].to_numpy("<i8").tobytes()], f"{name}_data": [x.tobytes()]})

    dealt = rows.select("id", "embedding", "cluster", F.expr(f"int(pmod(xxhash64(id), {groups}))").alias(deal))
    return dealt.groupBy("cluster", deal).applyInPandas(run, f"cluster int, {deal} int, {name}_ids binary, {name}_data binary")


def _first(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best, ties on nine places to the smaller id."""
    order = np.lexsort((ids, -np.round(scores, 9), rows))
    rows = rows[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    kept = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) < k
    return rows[kept], ids[order][kept], scores[order][kept]


def ivf_search(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """Approximate kNN by inner product: an equi-join on the probed clusters, exact within them. index is assign(corpus).

    A cluster's queries and members travel packed, in shares of some TILES and SHARE rows at most, by hash of id; each pair of
    shares is one matrix product. A query keeps one list of its k best over the shares of a cluster that a task meets in a row.
    """
    asked = assign(queries.select(F.col("qid").alias("id"), "embedding"), centroids, probes)
    tiles, shares = (max(1, -(-df.count() // size)) for df, size in ((queries, TILES), (index, SHARE)))
    q, c = _packed(asked, "tile", tiles, "q"), _packed(index, "share", shares, "c", k)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for f in frames:
            for cluster, tile, q_ids, q_data, c_ids, c_data in f.itertuples(index=False):
                if key != (cluster, tile):
                    if held:
                        yield pd.DataFrame(dict(zip(("qid", "id", "score"), held[0])))
                    key, held = (cluster, tile), []
                qids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                qs, cs = np.frombuffer(q_data, "<f8").reshape(len(qids), -1), np.frombuffer(c_data, "<f8").reshape(len(ids), -1)
                step = max(1, CELLS // len(ids))
                for a in range(0, len(qids), step):
                    s = qs[a : a + step] @ cs.T
                    edge = np.partition(s, -k, axis=1)[:, -k] - 2e-9 if len(ids) > k else np.full(len(s), -np.inf)
                    rows, cols = np.nonzero(s >= edge[:, None])
                    held.append(_first(qids[a : a + step][rows], ids[cols], s[rows, cols], k))
                held = [_first(*map(np.concatenate, zip(*held)), k)]
        if held:
            yield pd.DataFrame(dict(zip(("qid", "id", "score"), held[0])))

    met = c.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).join(q, ["cluster", "tile"])
    found = met.select("cluster", "tile", "q_ids", "q_data", "c_ids", "c_data").mapInPandas(search, "qid long, id long, score double")
    best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "rank", "id", "score")
