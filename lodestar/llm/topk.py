"""Exact top-k search by tiled matrix products.

Candidate rows are packed into shards, query rows into tiles, both as binary matrices of a bounded size; each (tile, shard)
cell is one matrix product with a partial selection. A query's partial lists are merged by a tree of top-k merges: a task keeps
one running list a query over all its cells, which is all that it writes; lists of FAN tasks are merged, then those of FAN such
merges, and so on, so that no merge takes more than FAN lists of a query. Tiles and shards meet by an equi-join on the cells of a grid: the stated query set against
all rows, in blocks.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, as query or candidate; a
query meets only candidates of its own dimension; rows without an id take no part; ties go to the smaller id; a repeated id is a row like any other, but a
query's own id is never its candidate; a query with fewer candidates than k returns all of them; an empty table gives an
empty result. Scores are sums of products of integers held as doubles: exact below 2**53.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

TILE, SHARD = 2048, 8192
FAN = 64  # lists of a query in one merge


def pack(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(id long, v array<double>) -> one row a block of at most `size` vectors of one dimension: dim, ids and data as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int, ids: list, vs: list) -> pd.DataFrame:
            return pd.DataFrame({"dim": [dim], f"{name}_ids": [np.concatenate(ids).astype("<i8").tobytes()], f"{name}_data": [np.concatenate(vs).astype("<f8").tobytes()]})

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1)
            dims = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                m = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                for a in range(0, len(at), size):
                    own = held.setdefault(int(dim), [0, [], []])
                    own[0] += len(at[a : a + size])
                    own[1].append(ids[at[a : a + size]])
                    own[2].append(m[a : a + size])
                    if own[0] >= size:
                        yield block(int(dim), own[1], own[2])
                        del held[int(dim)]
        for dim, (_, ids, vs) in held.items():
            yield block(dim, ids, vs)

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), (f"{name}_ids", pa.binary()), (f"{name}_data", pa.binary())])
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    return rows.mapInArrow(arrow, f"dim int, {name}_ids binary, {name}_data binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k highest scores with their ids, ties to the smaller id; every tie at the k-th place is looked at."""
    n, m = scores.shape
    if m > 4 * k:
        edge = np.partition(scores, m - k, axis=1)[:, m - k]
        some = scores >= edge[:, None]
        rows, cols = np.nonzero(some)
    else:
        rows, cols = np.divmod(np.arange(n * m), m)
    got, who = scores[rows, cols], ids[cols] if ids.ndim == 1 else ids[rows, cols]
    order = np.lexsort((who, -got, rows))
    rows, got, who = rows[order], got[order], who[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    out_s, out_i = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
    keep = place < k
    out_s[rows[keep], place[keep]], out_i[rows[keep], place[keep]] = got[keep], who[keep]
    return out_s, out_i


def cells(batches: Iterator[pd.DataFrame], k: int, task: int) -> Iterator[pd.DataFrame]:
    """(tile, shard) rows -> query_id, leaf and top, the task's k best of every query: a tile's running lists are merged cell by cell.

    A running list is k scores and ids a query, and a task holds those of the tiles that it meets.
    """
    held: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for frame in batches:
        for dim, qi, qd, ci, cd in frame[["dim", "q_ids", "q_data", "c_ids", "c_data"]].itertuples(index=False):
            qids, cids = np.frombuffer(qi, "<i8"), np.frombuffer(ci, "<i8")
            q, c = np.frombuffer(qd, "<f8").reshape(-1, dim), np.frombuffer(cd, "<f8").reshape(-1, dim)
            key = hashlib.blake2b(qi + qd, digest_size=16).digest()
            if key not in held:
                held[key] = qids, np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
            _, top, who = held[key]
            for a in range(0, len(q), 256):
                b = min(a + 256, len(q))
                s = q[a:b] @ c.T
                s[qids[a:b, None] == cids[None, :]] = -np.inf
                got, ids = best(s, cids, k)
                top[a:b], who[a:b] = best(np.hstack([top[a:b], got]), np.hstack([who[a:b], ids]), k)
    for qids, top, who in held.values():
        lists = [[{"s": -int(x), "i": int(i)} for x, i in zip(xs, ids) if np.isfinite(x)] for xs, ids in zip(top, who)]
        yield pd.DataFrame({"query_id": qids, "leaf": task, "top": lists})


def top_k(rows: DataFrame, is_query: Column, k: int = 5, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """rows: vec_id and v (array<double> of whole numbers) -> query_id, rank, vec_id, score."""
    valid = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col("vec_id").isNotNull())
    shards = pack(valid.select("vec_id", "v"), shard, "c")
    # tiles gather the queries of many tasks, in as many partitions as their number asks for
    queries = valid.filter(is_query).select("vec_id", "v")
    n = queries.count()
    tiles = pack(queries.repartition(max(1, -(-n // tile))), tile, "q")
    if n <= tile:  # counted: one tile
        joined = F.broadcast(tiles).join(shards, "dim")
    else:  # a grid of cells: each tile goes to every column, each shard to every row
        down, across = math.ceil(math.sqrt(n / tile)), math.ceil(math.sqrt(valid.count() / shard))
        every = lambda size, name: F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name)
        own = lambda ids, size, name: F.expr(f"int(pmod(xxhash64({ids}), {size}))").alias(name)
        left = tiles.select("*", own("q_ids", down, "down"), every(across, "across"))
        right = shards.select("*", own("c_ids", across, "across"), every(down, "down"))
        joined = left.join(right, ["dim", "down", "across"])
    lists = joined.mapInPandas(lambda it: cells(it, k, TaskContext.get().partitionId()), "query_id long, leaf long, top array<struct<s: long, i: long>>")
    merged = materialize(lists, "top-lists")
    level = merged.agg(F.coalesce(F.max("leaf"), F.lit(0)) + 1).first()[0]
    ordered = lambda a: F.slice(F.array_sort(a), 1, k)
    while level > 1:
        level = -(-level // FAN)
        merged = merged.groupBy("query_id", F.expr(f"leaf % {level}").alias("leaf")).agg(ordered(F.flatten(F.collect_list("top"))).alias("top"))
    merged = merged.filter(F.size("top") > 0)
    return merged.select("query_id", F.posexplode("top").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.i").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def op9_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double")).alias("v"), "embedding")
    # non-finite components must be seen before floor() turns them into numbers
    finite = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return top_k(rows.filter(finite).select("vec_id", "v"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
