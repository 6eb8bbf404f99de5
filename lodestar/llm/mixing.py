"""Mixing sources to target weights.

Sizes are aggregated per source, targets are levelled under a cap, and each document is emitted floor(rate) times plus
one hash-seeded Bernoulli copy with probability equal to the fraction. DataFrame functions only.

Defined cases: a null text has size 0; documents without words have the copies of their source's rate like any other
(a source without any word has rate 0, so its documents are not emitted); a null source is a source of its own, last in
order; equal (doc_id, source) rows draw alike, so reruns and repeated rows agree; an empty table gives an empty result.
Columns that the operator adds replace columns of the same names in its input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, packed, small, table

#: Weights in order of source, repeating, and the most that a source may be repeated.
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = 17


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, size) rows -> one row a source: source, source_size, weight, target.

    Targets share the total by weight; none exceeds max_repeat times its source's size. With sources in order of
    cap / weight the capped ones come first, so one running sum finds the level that the others share. The windows run over
    one row a source, after the partial aggregation.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    caps = stats.withColumn("weight", pick.cast("double")).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    levelled = caps.withColumn("place", F.row_number().over(level)).withColumn("level", (total - before) / rest)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))
    first = F.min(fits).over(Window.partitionBy())["level"]
    return levelled.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(first, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def draw(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the md5 of seed and key: the same wherever and whenever it is computed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and copies, the number of times that the mix takes each document."""
    clash = [c for c in docs.columns if c.lower() in {"size", "source_size", "weight", "target", "copies", "mix_rate", "mix_source"}]
    sized = docs.drop(*clash).withColumn("size", n_words(F.col("text")))
    targets = materialize(source_targets(sized.select("source", "size"), weights, max_repeat), "mix-targets")
    targets = small(targets.withColumnRenamed("source", "mix_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["mix_source"]), "left").withColumn("mix_rate", rate)
    whole = F.floor("mix_rate")
    copies = whole + (draw(F.col("doc_id"), seed) < F.col("mix_rate") - whole).cast("long")
    return joined.withColumn("copies", copies.cast("long")).drop("mix_source", "mix_rate", "weight")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The mixed corpus: docs' rows, each repeated as planned."""
    planned = plan_mix(packed(docs, "doc_id", "text", "source"), weights, max_repeat, seed).filter("copies > 0")
    return planned.select("row_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row_.*")


def op1_mixing(spark, sf_dir):
    plan = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: The mix as DuckDB SQL over a relation docs(doc_id, text, source).
MIX_SQL = r"""
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {docs}),
stats AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
caps AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         (3 * source_size)::DOUBLE AS cap FROM stats),
levelled AS (SELECT *, row_number() OVER w AS place,
    ((SELECT sum(source_size) FROM stats)::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM caps WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
targets AS (SELECT source AS mix_source, source_size, least(cap, weight * coalesce(
    (SELECT level FROM levelled WHERE level <= cap / weight ORDER BY place LIMIT 1), 'Infinity'::DOUBLE)) AS target FROM levelled),
rated AS (SELECT sized.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
    FROM sized LEFT JOIN targets ON source IS NOT DISTINCT FROM mix_source),
planned AS (SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
    / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
"""

OP1_SQL = f"WITH {MIX_SQL.format(docs='documents')} SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM planned"
