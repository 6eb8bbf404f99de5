"""Batch reshaping: repeats, chunks, padding, folding, reordering, balanced partitions."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeat(rows: DataFrame, n: int, position: str, interleave: bool = True) -> DataFrame:
    """Each row n times with out_position: copies next to each other, or the whole batch again and again."""
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return copies.withColumn("out_position", F.col(position) * n + F.col("copy"))
    size = rows.agg(F.count("*")).scalar()
    return copies.withColumn("out_position", F.col("copy") * size + F.col(position))


def repeat_each(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column says; 0 drops it."""
    return rows.filter(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col(times) - 1).cast("int"))))


def chunk(rows: DataFrame, position: str, chunks: int, padded: bool = False) -> DataFrame:
    """rows with chunk: equal contiguous parts by 0-based position; an error unless they divide evenly, or padded."""
    n = rows.count()
    if n % chunks and not padded:
        raise ValueError(f"{n} rows are not {chunks} equal parts")
    return rows.withColumn("chunk", F.floor(F.col(position) / F.lit(max(1, math.ceil(n / chunks)))).cast("int"))


def pad_to_divisor(rows: DataFrame, position: str, divisor: int) -> DataFrame:
    """rows with is_pad, the leading rows again (cycled) until the count divides evenly."""
    n = rows.count()
    need = -n % divisor if n else 0
    base = rows.withColumn("is_pad", F.lit(False))
    if not need:
        return base
    extra = rows.filter(F.col(position) < need).withColumn("again", F.explode(F.sequence(F.lit(0), F.lit((need - 1) // n)))).withColumn(position, F.lit(n) + F.col("again") * n + F.col(position)).filter(F.col(position) < n + need).drop("again")
    return base.unionByName(extra.withColumn("is_pad", F.lit(True)))


def unpad(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("is_pad")).drop("is_pad")


def unfold(rows: DataFrame, column: str, parts: int, size: int | None = None) -> DataFrame:
    """An array column cut into contiguous parts, one row each; the other columns repeat.

    Equal parts of each array, the last also holds what is left over; or, with size, parts of that many values whatever the array's
    length: a short array's last ones are short or empty, a long one has more than `parts`.
    """
    each = F.lit(size) if size else (F.size(column) / parts).cast("int")
    last = F.greatest(F.lit(parts), F.ceil(F.size(column) / size).cast("int")) - 1 if size else F.lit(parts - 1)
    length = lambda i: F.when(i == last, F.greatest(F.size(column) - i * each, F.lit(0))).otherwise(each)
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col(column), (i * each + 1).cast("int"), length(i)))).alias("part", column))


def fold(rows: DataFrame, position: str, size: int, columns: list[str]) -> DataFrame:
    """`size` rows by position into one of arrays."""
    gathered = F.array_sort(F.collect_list(F.struct(position, *columns)))
    g = rows.groupBy(F.floor(F.col(position) / size).cast("long").alias("fold")).agg(gathered.alias("g"))
    return g.select("fold", *[F.col(f"g.{c}").alias(c) for c in columns])


def reorder(rows: DataFrame, position: str, indices: DataFrame) -> DataFrame:
    """rows by an index table (out_position, index): row `index` goes to out_position."""
    return indices.join(rows.withColumnRenamed(position, "index"), "index").drop("index")


def inverse(indices: DataFrame) -> DataFrame:
    """The permutation that undoes (out_position, index)."""
    return indices.select(F.col("index").alias("out_position"), F.col("out_position").alias("index"))


def union_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows joined 1:1 on key; columns that both have must be equal, else an error."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in right.columns if c != key])
    joined = left.join(r, key)
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        joined = joined.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs"))))
    return joined.drop(*[f"__{c}" for c in shared])


def minibatches(rows: DataFrame, key: str, size: int, epochs: int = 1, seed: int = 0) -> DataFrame:
    """rows with epoch, batch: each epoch in its own hash order."""
    from .samples import with_position

    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    n = rows.count()
    order = each.withColumn("o_", F.concat_ws("|", F.lpad(F.col("epoch").cast("string"), 6, "0"), F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("epoch").cast("string"), F.lit(str(seed))))))
    return with_position(order, "o_").withColumn("batch", F.floor((F.col("position") - F.col("epoch") * n) / size).cast("int")).drop("o_", "position")


# --- balanced partitions

def workload(length: Column) -> Column:
    """Cost of a sequence: linear and quadratic in its length."""
    length = length.cast("long")
    return F.lit(24576).cast("long") * length + length * length


def karmarkar_karp(costs, k: int, equal: bool = False) -> list[list[int]]:
    """k parts of near-equal sums by largest differencing; with equal, of equal counts (which must divide)."""
    costs = [float(c) for c in costs]
    if k < 1 or len(costs) < k:
        raise ValueError(f"{len(costs)} items into {k} parts")
    if equal and len(costs) % k:
        raise ValueError(f"{len(costs)} items are not {k} equal counts")
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    heap = []
    for n, g in enumerate(groups):
        parts = sorted([(costs[i], [i]) for i in g] + [(0.0, [])] * (k - len(g)), key=lambda p: -p[0])
        heap.append((parts[-1][0] - parts[0][0], n, parts))
    heapq.heapify(heap)
    n = len(groups)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted([(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))], key=lambda p: -p[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], n, merged))
        n += 1
    return sorted(sorted(p) for _, p in heap[0][2])


def greedy_partition(costs, k: int) -> list[list[int]]:
    """Each item, dearest first, to the part with the least so far."""
    heap = [(0.0, i) for i in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        load, at = heapq.heappop(heap)
        parts[at].append(i)
        heapq.heappush(heap, (load + costs[i], at))
    return [sorted(p) for p in parts]


def balance(rows: DataFrame, batch: str, key: str, cost: str, k: int, equal: bool = False, greedy: bool = False) -> DataFrame:
    """(batch, key, part): each batch's items in k balanced parts. A batch is what one step trains on: one group, one task."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (batch, key)}

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        costs = f[cost].to_numpy(float)
        parts = greedy_partition(costs, min(k, len(f))) if greedy else karmarkar_karp(costs, min(k, len(f)), equal)
        out = np.empty(len(f), int)
        for p, items in enumerate(parts):
            out[items] = p
        return pd.DataFrame({batch: f[batch].to_numpy(), key: f[key].to_numpy(), "part": out})

    return rows.select(batch, key, cost).groupBy(batch).applyInPandas(run, f"`{batch}` {kinds[batch]}, `{key}` {kinds[key]}, part int")


def micro_batches(rows: DataFrame, batch: str, key: str, length: str, most: int, multiple: int = 1) -> DataFrame:
    """(batch, key, micro): as few parts as the token budget asks for, balanced by workload, small ones at both ends.

    A sequence longer than the budget is a part of its own; the others are balanced among themselves.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (batch, key)}

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key)
        n = f[length].to_numpy(float)
        whole, rest = np.flatnonzero(n > most), np.flatnonzero(n <= most)
        count = -(-(len(whole) + max(min(1, len(rest)), math.ceil(n[rest].sum() / most))) // multiple) * multiple
        parts = [[i] for i in whole]
        if len(rest):
            parts += [[rest[i] for i in p] for p in karmarkar_karp(24576 * n[rest] + n[rest] ** 2, min(len(n), count) - len(whole))]
        parts.sort(key=lambda p: sum(24576 * n[i] + n[i] ** 2 for i in p))
        parts = parts[::2] + parts[1::2][::-1]
        out = np.empty(len(f), int)
        for m, items in enumerate(parts):
            out[items] = m
        return pd.DataFrame({batch: f[batch].to_numpy(), key: f[key].to_numpy(), "micro": out})

    return rows.select(batch, key, length).groupBy(batch).applyInPandas(run, f"`{batch}` {kinds[batch]}, `{key}` {kinds[key]}, micro int")


def imbalance(rows: DataFrame, part: str, length: str) -> DataFrame:
    """One row: the smallest and largest sum of a part, their difference and mean."""
    sums = rows.groupBy(part).agg(F.sum(length).alias("s"))
    return sums.agg(F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("spread"), F.avg("s").alias("mean"))
